import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from slotwise.llm import bpe, packing, secrets
from slotwise.llm.queries import vocabulary

from .conftest import sentence

#: The last columns have names that stages use for their own.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _own_id long, __kept_id long, h string, label double, score double, t int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [sentence(rng, rng.randrange(5, 120)) for _ in range(150)]
    texts += [sentence(rng, 50) + " you zorbling idiot, you moron" for _ in range(60)]
    long = sentence(rng, 500)
    texts += [texts[0]] * 40 + [long + " end" * k for k in range(6)] + ["", "", "key password=" + "q" * 20, sentence(rng, 3000)]
    for k in range(12):  # near copies of many bits
        words = sentence(rng, 200).split()
        texts.append(" ".join(words))
        for at in rng.sample(range(5, 190), k % 6):
            words[at] = f"other{k}x{at}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rows += [(len(rows) + k, x) for k, x in enumerate([None, " \n", "x" * 100_000])]
    rows += [(None, None), (None, texts[0]), (None, "only here"), (None, "only here"), (7, texts[7]), (7, texts[7]), (7, "another text of row seven")]
    at = tmp_path_factory.mktemp("corpus")
    full = [(i, t, "en", f"src{k % 3}", len(t or ""), 1, 2, "h", 0.5, 0.5, 3) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, COLUMNS).repartition(4).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(150 <= i < 210), 1) for i in range(0, 250)], "doc_id long, toxic int, quality int").write.parquet(str(at / "labels.parquet"))
    return str(at), rows


def _shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def _order(i):
    return (i is None, i)


def test_pipeline_by_brute_force(spark, corpus):
    at, rows = corpus
    out = corpus_pipeline.run(spark, at).collect()
    by_text = {}
    for i, t in rows:
        if "zorbling" not in (t or ""):
            t = t or ""
            by_text[t] = max((x for x in (i, by_text.get(t)) if x is not None), default=None)
    left = sorted(((i, t) for t, i in by_text.items()), key=lambda x: _order(x[0])[0] * 1e9 + (x[0] or 0))
    sets, label = [_shingles(t) for _, t in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    first = {}
    for (i, t), g in zip(left, label):
        first.setdefault(g, (i, secrets.redacted(t)))
    assert len(first) < len(left) < len(rows)
    t, want = bpe.tokenizer(vocabulary("byte_bpe_50k.json")), Counter()
    for i, text in first.values():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.update((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut_pieces(len(ids), 1024)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    filled = defaultdict(int)
    for r in out:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024


def test_stages_keep_the_columns(spark, corpus):
    at, rows = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "secret scans", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).dtypes == docs.dtypes


def test_an_empty_table(spark, corpus, tmp_path):
    at, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
