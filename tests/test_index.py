import itertools

import pytest
from pyspark.sql import functions as F
from slotwise.operators import zonemap
from slotwise.operators.encoding import Encoding, IndexType
from slotwise.operators.index import BitmapIndex, ColumnReference, IndexAccuracy, coarse, coarse_index, default_basis
from slotwise.operators.predicates import Compare, IntervalFlags, Not, between
from slotwise.sources import store
from slotwise.streaming.ingest import index_of, ingest

HOW = [{"encoding": e, "index_type": t} for e, t in itertools.product(Encoding, IndexType)]
COUNTRIES = [(15, "armenia"), (16, "india"), (17, "japan"), (19, "india"), (25, "korea"), (30, "USA")]
SMALL = [(15, 4), (16, 5), (17, 4), (19, 5), (25, 7), (30, 4), (40, 8)]
LARGE = [(d, v * 100_000_000) for d, v in SMALL]


def _index(spark, rows, kind="long", **how):
    return BitmapIndex.build(spark.createDataFrame(rows, f"doc long, value {kind}"), **how)


def _ids(index, predicate, rg_id=None):
    return index.find(predicate).values(rg_id)


@pytest.mark.parametrize("how", HOW, ids=lambda h: f"{h['encoding'].name}-{h['index_type'].name}")
def test_lookups(spark, how):
    for rows, kind, asked in ((COUNTRIES, "string", {"india": [16, 19], "armenia": [15]}), (SMALL, "long", {4: [15, 17, 30], 8: [40]}), (LARGE, "long", {400000000: [15, 17, 30], 800000000: [40]})):
        index = _index(spark, rows, kind, **how)
        for value, want in asked.items():
            assert sorted(r["doc"] for r in index.lookup(value).collect()) == want


@pytest.mark.parametrize("how", HOW[::2], ids=lambda h: h["encoding"].name)
def test_nulls_absences_signs(spark, how):
    index = _index(spark, [(1, -5), (2, None), (3, 0), (4, 7), (5, None), (6, 7)], **how)
    value = lambda op, v: Compare("value", op, v)
    assert _ids(index, value("<>", 7)) == _ids(index, Not(value("=", 7))) == [1, 3]
    assert _ids(index, value("=", 3)) == [] and _ids(index, value(">=", 3)) == [4, 6] and _ids(index, value("<", 0)) == [1]
    assert _ids(index, value("=", None)) == _ids(index, Not(value("=", None))) == []
    assert sorted(r["doc"] for r in index.existence("value").collect()) == [1, 3, 4, 6]


def test_every_comparison_by_brute_force(spark):
    rows = [(i, (i * 7) % 23 - 5 if i % 6 else None) for i in range(200)]
    for how in ({"encoding": Encoding.INTERVAL}, {"encoding": Encoding.RANGE, "basis": (3, 2, 4)}, {"encoding": Encoding.EQUALITY, "index_type": IndexType.BITSLICED}):
        index = _index(spark, rows, **how)
        a, b, c = Compare("value", ">", 2.5), Compare("value", "<=", 9), Compare("value", "<>", 4)
        checks = {a & b: lambda v: v > 2.5 and v <= 9, a | c: lambda v: v > 2.5 or v != 4, b - c: lambda v: v <= 9 and v == 4, a ^ b: lambda v: (v > 2.5) != (v <= 9), ~(a & c): lambda v: not (v > 2.5 and v != 4)}
        for flags, low, high in zip(IntervalFlags, (1, 0, 1, 0), (1, 1, 0, 0)):
            checks[between("value", 3, 9, flags)] = lambda v, low=low, high=high: 3 + low <= v <= 9 - high
        for predicate, holds in checks.items():
            assert _ids(index, predicate) == [i for i, v in rows if v is not None and holds(v)]


def test_null_logic_across_columns(spark):
    rows = [(i, x, y) for i, (x, y) in enumerate(itertools.product((None, 0, 1), repeat=2))]
    frame = spark.createDataFrame(rows, "doc long, x int, y int")
    index = BitmapIndex.over(frame, "doc", ["x", "y"])
    a, b = Compare("x", "=", 1), Compare("y", "=", 1)
    for p in (a & b, a | b, a ^ b, a - b, ~(a & b), ~(a | b), ~(a ^ b)):
        assert _ids(index, p) == sorted(r["doc"] for r in frame.where(p.as_column()).collect())


def test_batch_round_trip(spark, tmp_path):
    root = str(tmp_path / "index")
    values = spark.range(9 * 16000).selectExpr("cast(id div 16000 AS int) AS rg_id", "id % 16000 AS doc", "10 * (id % 16000) + id div 16000 AS value")
    path = "some.test.dotted.path"
    store.Builder(root).add_index(values, path, Encoding.INTERVAL).add_index(values.withColumn("value", F.col("value") % 7), "other", Encoding.RANGE).save_all()
    index = store.get_index(spark, root, 0, path)
    found = index.find(Compare(path, ">=", 159990))
    assert found.accuracy is IndexAccuracy.EXACT and found.values() == [15999]
    every = store.load(spark, root)
    assert set(every.entries) == {path, "other"}
    counts = {r["rg_id"]: r["n"] for r in every.find(Compare(path, ">=", 159990) & Compare("other", ">=", 0)).per_row_group().collect()}
    assert counts == {i: 1 for i in range(9)}
    with pytest.raises(store.IndexNotFound):
        store.get_index(spark, root, 99, path)
    with pytest.raises(store.IndexNotFound):
        store.load(spark, root, ["missing"])
    with pytest.raises(store.IndexNotFound):
        store.load(spark, str(tmp_path / "nothing"))


def test_stored_slots(spark, tmp_path):
    index = _index(spark, [(28, 0), (158, 0), (15, 1), (27, 1), (37, 1)], basis=(2, 2, 2))
    store.save(index, str(tmp_path))
    again = store.load(spark, str(tmp_path))
    from slotwise.functions.bitset import BitMap

    assert BitMap(again.slot("value", 2, 0)).values() == [28, 158]
    assert sorted(r["doc"] for r in again.existence("value").collect()) == [15, 27, 28, 37, 158]


def test_one_exchange_a_predicate(spark):
    index = BitmapIndex.over(spark.createDataFrame([(i, i % 9, i % 5) for i in range(300)], "doc long, x int, y int"), "doc", ["x", "y"], encoding=Encoding.INTERVAL)
    from slotwise.sources.shared import cut

    index = BitmapIndex(cut(index.rows), index.dictionaries, index.entries)
    plan = index.words((Compare("x", ">=", 3) & Compare("y", "=", 2)) | ~Compare("x", "<", 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    one = BitmapIndex(index.rows, index.dictionaries, index.entries | {"x": index.entries["x"]})
    flat = _index(spark, SMALL)
    flat = BitmapIndex(cut(flat.rows), flat.dictionaries, flat.entries)
    plan = flat.words(Compare("value", "=", 4))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull" in plan
    assert one.entries["x"].cardinality == 9


def test_bounds(spark):
    with pytest.raises(ValueError, match="fit"):
        _index(spark, SMALL, basis=(3,))
    with pytest.raises(ValueError, match="several values"):
        _index(spark, [(1, 2), (1, 3)], encoding=Encoding.RANGE)
    many = _index(spark, [(1, 2), (1, 3), (2, 3)], several=True)
    assert _ids(many, Compare("value", "=", 3)) == [1, 2] and _ids(many, Compare("value", "=", 2)) == [1]
    assert default_basis(IndexType.BITMAP, 256).bases == (256,) and default_basis(IndexType.BITMAP, 257).bases == (16, 16, 16)
    assert _ids(_index(spark, [(1, None)]), Compare("value", ">=", 0)) == []


def test_accuracy(spark):
    frame = spark.createDataFrame([(i, i * 0.7 - 20) for i in range(100)], "doc long, value double")
    asked = Compare("value", ">=", 3.3) & Compare("value", "<", 21.0)
    want = sorted(r["doc"] for r in frame.where(asked.as_column()).collect())
    rough = coarse_index(frame, "value", 5.0, encoding=Encoding.RANGE)
    wide = rough.find(coarse(asked, 5.0))
    assert wide.accuracy is IndexAccuracy.COARSE and set(want) < set(wide.values())
    assert sorted(r["doc"] for r in rough.semi_join(frame, "doc", coarse(asked, 5.0), residual=asked.as_column()).collect()) == want
    none = BitmapIndex.build(frame, "other")
    assert none.find(asked).accuracy is IndexAccuracy.NONE
    assert sorted(r["doc"] for r in none.semi_join(frame, "doc", asked).collect()) == want
    with pytest.raises(ValueError):
        coarse(~asked, 5.0)


def test_dotted_paths(spark):
    frame = spark.createDataFrame([(1, '{"k": {"j": 9}}', (5,)), (2, '{"k": {}}', (6,)), (3, None, None)], "doc long, props string, s struct<a:int>")
    index = BitmapIndex.over(frame, "doc", [ColumnReference("props.k.j", "long"), "s.a"])
    assert _ids(index, Compare("props.k.j", "=", 9)) == [1] and _ids(index, Compare("s.a", ">=", 5)) == [1, 2]


def test_zone_maps(spark):
    frame = spark.createDataFrame([(i, -1.5 - i, 2**31 - 1 if i < 99 else None) for i in range(100)], "doc int, d double, n int")
    group = (F.col("doc") / 10).cast("int")
    zones = zonemap.zone_map(frame, "d", group)
    assert tuple(zones.where("rg_id = 0").first())[1:3] == (-10.5, -1.5)
    assert zonemap.zone_map(frame, "n", F.lit(0)).first()["sum_value"] == 99 * (2**31 - 1)
    for p in (Compare("d", ">", -3.0), Compare("d", "=", -50.5), between("d", -20, -10), Not(Compare("d", ">", -3.0))):
        assert zonemap.pruned(frame, zones, group, p).count() == frame.where(p.as_column()).count()
    assert zones.where(zonemap.may_hold(Compare("d", ">", -3.0))).count() == 1


def test_open_indexes(spark):
    cache, made, gone = store.OpenIndexes(), [], []
    make = lambda: made.append(1) or _index(spark, SMALL)
    a, b = cache.reserve("x", make), cache.reserve("x", make)
    assert a is b and len(made) == 1 and len(cache) == 1 and cache.get("x") is a and cache.get("y") is None
    cache.release("x", gone.append)
    assert not gone and len(cache) == 1
    cache.release("x", gone.append)
    assert gone == [a] and len(cache) == 0
    with pytest.raises(store.IndexNotFound):
        cache.release("x")
    with pytest.raises(RuntimeError):
        cache.reserve("x", lambda: (_ for _ in ()).throw(RuntimeError()))
    assert len(cache) == 0


def test_streamed_documents(spark, tmp_path):
    source, stored = str(tmp_path / "in"), str(tmp_path / "words")
    schema = "rg_id int, doc long, value long"
    for k in range(2):
        spark.createDataFrame([(0, d + 100 * k, v + k) for d, v in SMALL], schema).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(schema).parquet(source), stored, str(tmp_path / "check")).awaitTermination()
    index = index_of(spark, stored, encoding=Encoding.INTERVAL)
    assert _ids(index, Compare("value", "=", 5)) == [16, 19, 115, 117, 130]


@pytest.mark.parametrize("cardinality", [256, 257, 300])
def test_several_values_a_document(spark, cardinality):
    rows = [(d, v) for v in range(cardinality) for d in {v % 40, (v * 7) % 40}] + [(50, 1), (50, 16)]
    index = _index(spark, rows, several=True)
    for v in (0, 1, 5, 16, 17, 255):
        assert sorted(r["doc"] for r in index.lookup(v).collect()) == sorted({d for d, x in rows if x == v})
    assert _ids(index, Compare("value", "<=", 3)) == sorted({d for d, x in rows if x <= 3})
    for how in ({}, {"encoding": Encoding.RANGE}, {"encoding": Encoding.INTERVAL}, {"index_type": IndexType.BITSLICED}):
        with pytest.raises(ValueError, match="several values"):
            _index(spark, rows, **how)
        if how:
            with pytest.raises(ValueError, match="one component"):
                _index(spark, rows, several=True, **how)


def test_a_save_that_fails_leaves_the_old_column(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store.save(_index(spark, SMALL), root)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fail)
        with pytest.raises(OSError):
            store.save(_index(spark, [(1, 4), (2, 9)]), root)
    assert sorted(r["doc"] for r in store.load(spark, root).lookup(4).collect()) == [15, 17, 30]
    store.save(_index(spark, [(1, 4), (2, 9)]), root)
    again = store.load(spark, root)
    assert sorted(r["doc"] for r in again.lookup(4).collect()) == [1] and again.entries["value"].cardinality == 2
    assert len(list((tmp_path / "rows" / "column_path=value").glob("version=*"))) == 1


def test_release_while_another_builds(spark):
    import threading

    cache, go, begun = store.OpenIndexes(), threading.Event(), threading.Event()

    def make():
        begun.set()
        go.wait(30)
        return _index(spark, SMALL)

    maker = threading.Thread(target=lambda: cache.reserve("x", make))
    maker.start()
    begun.wait(30)
    with pytest.raises(store.IndexNotFound):
        cache.release("x")
    go.set()
    maker.join()
    assert cache.get("x") is not None
    cache.release("x")
    assert len(cache) == 0


def test_pruned_reads_a_range(spark, tmp_path):
    spark.range(10_000).selectExpr("id AS doc", "id * 3 AS v").write.parquet(str(tmp_path / "t"))
    table, group = spark.read.parquet(str(tmp_path / "t")), F.floor(F.col("doc") / 1000).cast("int")
    zones = zonemap.zone_map(table, "v", group, "doc")
    found = zonemap.pruned(table, zones, group, between("v", 6100, 8000), "doc")
    assert found.count() == sum(6100 <= 3 * i <= 8000 for i in range(10_000))
    assert "GreaterThanOrEqual(doc,2000)" in found._jdf.queryExecution().executedPlan().toString()
    assert zonemap.pruned(table, zones, group, Compare("v", "<", 0), "doc").count() == 0
