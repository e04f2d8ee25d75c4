import glob
import os

import duckdb
import pytest
import __spark_entry__ as entry
from slotwise.plans import catalogue

DATA = "/root/testdata/sf0.001"
SOME = ["eq_interval_bitsliced", "ge_absent", "xor_two_columns", "dotted_path_eq", "coarse_recheck", "dictionary_rank", "decompose_mixed", "bitmap_flip", "bitmap_contains", "bitmap_min_max", "zonemap_prune", "index_round_trip", "per_rowgroup_counts", "bitmap_add", "bitmap_clear", "bitmap_in_order", "bitmap_round_trip", "stored_ge", "get_index_ge", "slot_round_trip", "eq_multi_value", "index_stats", "semi_join_rows"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].to_dict("split")["data"]))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 134
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
