"""What the dedup stages write to disk beside their results."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from slotwise.llm import common, exact_dedup, near_copies
from slotwise.sources import shared

from .conftest import sentence


def _tables(spark):
    return set(Path(shared.shared_dir(spark).removeprefix("file:")).glob("slotwise-*"))


def _size(paths):
    return sum(p.stat().st_size for at in paths for p in at.rglob("*.parquet"))


def _moved(spark):
    """Shuffle bytes written by each stage that the session still knows."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, no = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, no)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def _unlike(n):
    rng = random.Random(5)
    return [" ".join(f"{rng.getrandbits(64):x}" for _ in range(80)) for _ in range(n)]


@pytest.mark.parametrize("normalise", [None, F.lower])
def test_exact_dedup_tables_hold_no_light_texts(spark, tmp_path, normalise):
    texts = _unlike(1500)
    heavy = " ".join(texts[:40])
    rows = list(enumerate([*texts, *texts[:30], *[heavy] * 40]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    before = _tables(spark)
    out = exact_dedup.without_copies(spark.read.parquet(str(tmp_path / "docs")), range_bytes=400_000, normalise=normalise)
    want = sorted({t: i for i, t in rows}.values())
    assert sorted(r["doc_id"] for r in out.collect()) == want
    out.write.parquet(str(tmp_path / "out"))
    assert 0 < _size(_tables(spark) - before) < 0.6 * _size([tmp_path / "out"])


def test_near_dedup_moves_no_texts_without_candidates(spark, tmp_path):
    texts = _unlike(1500)
    rows = list(enumerate([*texts, *(t + " end" for t in texts[:20]), texts[30]])) + [(None, texts[40]), (None, "alone"), (50, texts[50])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    known, limit = _moved(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_copies.without_near_copies(docs).select("doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, i) for i in range(1500)] + [(True, 0)]
    most = max(n for k, n in _moved(spark).items() if k not in known)
    assert 0 < most < total / 4


@pytest.mark.parametrize("words", [1 << 19, 2])
def test_sieve_passes_every_hash(spark, monkeypatch, words):
    monkeypatch.setattr(common, "SIEVE_WORDS", words)
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"), F.lit(1).alias("word"), F.lit(2).alias("_own_bits"))
    with common.scratch(spark):
        sieve = common.Sieve(rows.where("id % 50 = 0").select("h"))
        passed, rest = sieve.parted(rows, F.col("h"))
        ids = {r["id"] for r in passed.collect()}
        assert passed.columns == rows.columns and ids >= set(range(0, 20_000, 50))
        assert sorted(ids | {r["id"] for r in rest.collect()}) == list(range(20_000)) and len(ids) + rest.count() == 20_000
        assert sieve.table.count() <= words and (words == 2 or len(ids) < 3000)
        passed, rest = common.Sieve(rows.where("id < 0").select("h")).parted(rows, F.col("h"))
        assert passed.count() == 0 and rest.count() == 20_000
