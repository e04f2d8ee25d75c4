from pathlib import Path

from pyspark.sql import functions as F

from slotwise.sources import shared


def _tables(spark):
    return {p.name for p in Path(shared.shared_dir(spark).removeprefix("file:")).glob("slotwise-*")}


def test_scratch_removes_its_tables_and_hands_kept_ones_on(spark):
    before = _tables(spark)
    with shared.scratch(spark):
        with shared.scratch(spark):
            shared.cut(spark.range(3))
            kept = shared.cut(spark.range(5), keep=True)
        assert kept.count() == 5 and len(_tables(spark) - before) == 1
        last = shared.cut(spark.range(7), keep=True)
    assert last.count() == 7 and len(_tables(spark) - before) == 1
    shared.drop(last)
    assert _tables(spark) == before


def test_a_cut_releases_its_shuffles_and_leaves_the_setting(spark):
    was = spark.conf.get(shared._TIDY, None)
    found = shared.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(shared._TIDY, None) == was
    assert found.count() == 7 and found.agg(F.sum("count")).first()[0] == 1000
    shared.drop(found)
