import random

import pytest

WORDS = "the of and thing ring haste onward lesser ember tundra violet marble copper sonder quiet river".split()
#: Columns whose names some operator uses for its own.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int, id long, h long, t string, block int, rank long, label double"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """(doc_id, text): nulls, empties, a very long text, ties, repeated rows, odd characters."""
    rng = random.Random(7)
    hot = sentence(rng, 40)
    near = sentence(rng, 400)
    rows = [(i, hot) for i in range(60)] + [(60 + i, sentence(rng, 60)) for i in range(60)]
    rows += [(200 + i, near + " tail" * (i % 3)) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "   \n\t "), (None, "no number"), (None, None), (303, "x" * 300_000), (304, sentence(rng, 50_000))]
    rows += [(305, "same row"), (305, "same row"), (305, "other text, same number")]
    rows += [(306, "Ünïcödé ΑΣ. Σας <|endoftext|>a. é. é. 日本語、テスト "), (307, "it's 'quoted', isn't it?! ...   x\u0085y \x1c z"), (308, "<|startoftext|> İ \U0001f600 ²½")]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    full = [(i, t, "en", "src", len(t or ""), 0.5, True, 1, 9, 9, "q", 3, 4, 1.0) for i, t in hard_rows]
    return spark.createDataFrame(full, EXTRA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EXTRA)
