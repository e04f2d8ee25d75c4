"""Statistics of a column in each row group, and what they rule out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.operators.predicates import Both, Compare, Not, Predicate


def zone_map(df: DataFrame, column: str, rg_id: Column, doc: str | None = None) -> DataFrame:
    """(rg_id, min_value, max_value, sum_value, n) of the column's values; nulls don't count.
    With ``doc``, also first_doc and last_doc: the range of the row group's ids.

    Sums of whole numbers are 64-bit and fail on overflow. A row group without values has
    nulls, and n = 0.
    """
    value = F.col(column)
    ids = [F.min(doc).alias("first_doc"), F.max(doc).alias("last_doc")] if doc else []
    return df.groupBy(rg_id.alias("rg_id")).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.sum(value).alias("sum_value"), F.count(value).alias("n"), *ids)


def as_double(zones: DataFrame) -> DataFrame:
    """(rg_id, min_value, max_value), both as doubles."""
    return zones.select("rg_id", F.col("min_value").cast("double").alias("min_value"), F.col("max_value").cast("double").alias("max_value"))


def may_hold(predicate: Predicate) -> Column:
    """Whether a row group of a zone map of the predicate's one column may have a match."""
    if isinstance(predicate, Both) and predicate.op in ("and", "or"):
        a, b = may_hold(predicate.left), may_hold(predicate.right)
        return a & b if predicate.op == "and" else a | b
    low, high = F.col("min_value"), F.col("max_value")
    if isinstance(predicate, Not) or not isinstance(predicate, Compare):
        return F.col("n") > 0
    v = F.lit(predicate.value)
    held = {"=": (low <= v) & (v <= high), "<>": (low != v) | (high != v), "<": low < v, "<=": low <= v, ">": high > v, ">=": high >= v}[predicate.op]
    return F.coalesce(held, F.lit(False))


def pruned(df: DataFrame, zones: DataFrame, rg_id: Column, predicate: Predicate, doc: str | None = None) -> DataFrame:
    """The rows that satisfy ``predicate``, read from row groups that may have any.

    ``zones`` is a stored zone map. If it has the ranges of ids, and ``doc`` names their
    column, the range of all row groups that are left becomes a filter of the scan.
    """
    kept = zones.where(may_hold(predicate))
    if doc and "first_doc" in zones.columns:
        first, last = kept.agg(F.min("first_doc"), F.max("last_doc")).first()
        df = df.where(F.lit(False)) if first is None else df.where(F.col(doc).between(first, last))
    keep = kept.select(F.col("rg_id").alias("_rg"))
    return df.join(keep, rg_id == F.col("_rg"), "left_semi").where(predicate.as_column())
