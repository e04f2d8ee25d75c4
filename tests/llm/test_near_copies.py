import random

import corpus_pipeline
from slotwise.llm import near_copies, simhash

from .conftest import sentence


def _jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(a & b) / len(a | b)


def test_stage_drops_copies_of_many_bits(spark):
    rng = random.Random(3)
    texts = []
    for k in range(40):
        words = sentence(rng, 200).split()
        texts.append(" ".join(words))
        for at in rng.sample(range(5, 190), k % 6):
            words[at] = f"other{k}x{at}"
        texts.append(" ".join(words) + " end")
    texts += ["", " \n", "one two", "One  two", "one three"]
    n = len(texts)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and _jaccard(texts[i], texts[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    want = {min(i for i in range(n) if label[i] == g) for g in set(label)}
    far = [i for i in range(0, 80, 2) if i + 1 not in want and (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i + 1])).bit_count() > 3]
    assert len(far) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == sorted(want)


def test_bridges_and_empty(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[k * 12 : k * 12 + 120]) for k in range(8)]  # neighbours alike, ends not
    assert _jaccard(chain[0], chain[1]) >= 0.8 > _jaccard(chain[0], chain[2])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(chain)] + [(None, chain[3]), (3, chain[3])], "doc_id long, text string")
    assert [r["doc_id"] for r in near_copies.without_near_copies(docs).collect()] == [0]
    assert near_copies.without_near_copies(docs.limit(0)).count() == 0
