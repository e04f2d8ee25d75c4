import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from slotwise.llm import exact_dedup, simhash
from slotwise.llm.components import components


@pytest.mark.parametrize("size", [exact_dedup.RANGE_BYTES, 4000])
def test_exact_dedup(hard, hard_rows, size):
    out = exact_dedup.exact_dedup(hard, range_bytes=size).collect()
    groups = defaultdict(list)
    for i, t in hard_rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    kept = [(r["doc_id"], r["text_sha256"]) for r in out if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_exact_dedup_rows(hard, hard_rows):
    out = exact_dedup.without_copies(hard)
    assert out.columns == hard.columns
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in hard_rows})


def _groups(prints, distance):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_simhash(hard, hard_rows):
    out = simhash.simhash_groups(hard).collect()
    prints = [simhash.fingerprint(t) for _, t in hard_rows]
    label = _groups(prints, 3)
    least = {g: min((i for (i, _), x in zip(hard_rows, label) if x == g and i is not None), default=None) for g in label}
    want = Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(hard_rows, prints, label))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == want


def test_simhash_rows(hard, hard_rows):
    out = simhash.without_near_copies(hard)
    assert out.columns == hard.columns
    label = _groups([simhash.fingerprint(t) for _, t in hard_rows], 3)
    assert out.count() == len(set(label))


def test_fingerprint_by_hand():
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d e")]
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > 3)
    assert simhash.fingerprint("A b\tC\n d  e") == want
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("distance,block", [(3, 1024), (3, 8), (2, 8)])
def test_links_connect_as_all_pairs_do(spark, distance, block):
    rng = np.random.default_rng(5)
    points = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for x in list(points)[:40]:  # chains and dense groups
        for _ in range(12):
            x ^= sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False))
            points.add(x)
    points = sorted(points)
    frame = spark.createDataFrame([(x,) for x in points], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.links(frame, distance, block)).collect()}
    label, found = _groups(points, distance), defaultdict(set)
    for x, g in zip(points, label):
        found[g].add(root.get(x, x))
    assert all(len(x) == 1 for x in found.values()) and len({next(iter(x)) for x in found.values()}) == len(found)


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in rng.integers(-(1 << 63), 1 << 63, (200, 2))]
    frame = spark.createDataFrame(rows, "a long, b long")
    got = frame.select("a", "b", simhash.embedded(frame.a).alias("x"), simhash.embedded(frame.b).alias("y")).collect()
    for r in got:
        a, b = r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)
        manhattan = sum(abs((a >> 2 * s & 3).bit_count() - (b >> 2 * s & 3).bit_count()) for s in range(32))
        assert ((r["x"] ^ r["y"]) & (2**64 - 1)).bit_count() == manhattan <= (a ^ b).bit_count()


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert root == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.without_copies(empty).count() == 0
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.without_near_copies(empty).count() == 0
