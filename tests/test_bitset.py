import random

import pytest
from slotwise.functions.bitset import BitMap, pack, unpack

EDGES = [0, 62, 63, 64, 127, 128, 4294967295]


def test_word_boundaries(spark):
    held = BitMap.of_values(spark, EDGES)
    assert held.values() == EDGES
    stats = held.statistics().first()
    assert (stats["cardinality"], stats["is_empty"], stats["minimum"], stats["maximum"]) == (7, False, 0, 4294967295)
    assert 63 in held and 65 not in held and list(held) == EDGES
    assert held.as_array().first()["docs"] == EDGES


def test_small_round_trip(spark, tmp_path):
    path = str(tmp_path / "b")
    BitMap.of_values(spark, [10, 12, 17, 19]).write(path)
    loaded = BitMap.read(spark, path)
    assert loaded.values() == [10, 12, 17, 19] and loaded.byte_size() == 16


def test_large_round_trip(spark, tmp_path):
    path = str(tmp_path / "b")
    BitMap.of(spark.range(1_000_000).selectExpr("id * 9 AS doc")).write(path)
    loaded = BitMap.read(spark, path)
    assert loaded.contains(99918) and not loaded.contains(99919) and loaded.cardinality() == 1_000_000


def test_algebra(spark):
    rng = random.Random(2)
    a, b = ({rng.randrange(300) for _ in range(100)} | {x} for x in (63, 4294967295))
    x, y = BitMap.of_values(spark, a), BitMap.of_values(spark, b)
    assert (x & y).values() == sorted(a & b)
    assert (x | y).values() == sorted(a | b)
    assert (x - y).values() == sorted(a - b)
    assert (x ^ y).values() == sorted(a ^ b)
    assert BitMap.union([x, y, BitMap.of_values(spark, [7])]).values() == sorted(a | b | {7})


@pytest.mark.parametrize("begin,end", [(0, 64), (5, 5), (9, 3), (1, 63), (63, 65), (60, 200), (4294967290, 1 << 32)])
def test_ranges(spark, begin, end):
    assert BitMap.of_range(spark, begin, end).values() == list(range(begin, end))
    held = {1, 64, 100}
    assert BitMap.of_values(spark, held).add_range(begin, end).values() == sorted(held | set(range(begin, end)))
    assert BitMap.of_values(spark, held).flip(begin, end).values() == sorted(held ^ set(range(begin, end)))


def test_empty(spark):
    none = BitMap.empty(spark)
    assert none.is_empty() and none.cardinality() == 0 and none.minimum() is None and none.maximum() is None
    full = BitMap.of_values(spark, [3]).add(5, 6)
    assert full.values() == [3, 5, 6] and full.clear().is_empty() and (full - full).is_empty()


def test_ids_out_of_range(spark):
    for wrong in (-1, 1 << 32):
        with pytest.raises(Exception, match="document id"):
            BitMap.of_values(spark, [wrong]).values()
    with pytest.raises(ValueError):
        BitMap.of_range(spark, 0, (1 << 32) + 1)


def test_pack_by_group(spark):
    rows = spark.createDataFrame([(1, 5), (1, 70), (2, 5), (2, None)], "g int, doc long")
    assert {tuple(r) for r in unpack(pack(rows, "doc", ["g"]), ["g"]).collect()} == {(1, 5), (1, 70), (2, 5)}
