"""Gapless global ranks without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.sources.shared import cut

#: Partitions up to which their offsets are a literal in the plan; beyond, they are joined.
LITERAL = 4096


def ranked(df: DataFrame, by: Iterable[Column | str], rank: str = "rank") -> DataFrame:
    """``df`` with a gapless global ``rank`` from 0 in the order ``by``."""
    return ranked_and_counted(df, by, rank)[0]


def ranked_and_counted(df: DataFrame, by: Iterable[Column | str], rank: str = "rank") -> tuple[DataFrame, int]:
    """As ``ranked``, and the number of rows.

    Rows are dealt by sampled ranges and sorted within partitions; the table is cut, so that a
    rerun can't deal it differently; the offset of each partition, one row each, is then added.
    """
    by = list(by)
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    if len(offsets) <= LITERAL:
        start = F.element_at(F.array(*(F.lit(x).cast("long") for x in offsets or [0])), part + 1)
        return placed.withColumn(rank, start + own).drop("_at"), total
    table = df.sparkSession.createDataFrame(list(enumerate(offsets)), "_p int, _off long")
    joined = placed.withColumn("_p", part).join(F.broadcast(table), "_p")  # one row a partition
    return joined.withColumn(rank, F.col("_off") + own).drop("_at", "_p", "_off"), total
