from collections import Counter, defaultdict

import pytest
from slotwise.llm import sharding


def _whole(spark, texts, shards):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(frame, shards).collect()}
    counts = Counter(out.values())
    assert len(out) == len(texts) and max(counts.values()) - min(counts.values()) <= 1
    groups = defaultdict(set)
    for i, t in enumerate(texts):
        groups[t].add(out[i])
    return groups


@pytest.mark.parametrize("size", [2, 8])
def test_a_table_of_copies_only(spark, size):
    groups = _whole(spark, [f"text {i % (4000 // size)}" for i in range(4000)], 10)
    assert sum(len(x) > 1 for x in groups.values()) <= 20  # two at the ends of each shard


def test_hot_groups_take_few_shards(spark):
    groups = _whole(spark, ["hot"] * 900 + ["warm"] * 150 + [f"text {i % 400}" for i in range(950)], 10)
    assert len(groups["hot"]) == 5 and len(groups["warm"]) == 1
    assert sum(len(x) > 1 for x in groups.values()) <= 21


def _propagated(groups, shards, rounds=20):
    """Cut edges of label propagation done row by row: a row moves to the commonest shard of its
    group that has room, or changes places with a row without links there."""
    rows = [g for g, n in enumerate(groups) for _ in range(n)]
    shard = [hash((k * 2654435761) % 1009) % shards for k in range(len(rows))]
    room = [-(-len(rows) // shards)] * shards
    load = Counter(shard)
    alone = [k for k, g in enumerate(rows) if groups[g] == 1]
    of = defaultdict(list)
    for k, g in enumerate(rows):
        of[g].append(k)
    for _ in range(rounds):
        for members in of.values():
            if len(members) > 1:
                for k in members:
                    best = Counter(shard[m] for m in members).most_common(1)[0][0]
                    if shard[k] == best:
                        continue
                    swap = next((a for a in alone if shard[a] == best), None) if load[best] >= room[best] else None
                    if load[best] < room[best] or swap is not None:
                        if swap is not None:
                            shard[swap] = shard[k]
                            load[shard[k]] += 1
                            load[best] -= 1
                        load[shard[k]] -= 1
                        load[best] += 1
                        shard[k] = best
    return sum(shard[a] != shard[b] for members in of.values() for x, a in enumerate(members) for b in members[:x])


def test_no_more_cut_edges_than_propagation_by_rows(spark):
    groups = [1] * 300 + [2] * 60 + [5] * 30 + [20] * 8
    texts = [f"text {g}" for g, n in enumerate(groups) for _ in range(n)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(frame, 8).collect()}
    of = defaultdict(list)
    for i, t in enumerate(texts):
        of[t].append(out[i])
    cut = sum(a != b for x in of.values() for k, a in enumerate(x) for b in x[:k])
    assert cut <= _propagated(groups, 8)
