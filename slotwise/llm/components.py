"""Connected components of an edge table by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternates two rewritings of the edge set, each one pre-aggregated minimum and one join:
    every neighbour above a node is hung on the smallest neighbour (large star), then every
    neighbour below it is (small star). Paths halve each round, so a handful of rounds will
    do; the edges are cut to a table each round and never leave the executors. The minima are
    cut to a table too, so that each join is between two exchanges, and adaptive execution can
    split the rows of a hub. Tables that are read no more are removed.

    Nulls and self-links are ignored. Repeated links count once. Stops when a round changes
    nothing. An empty table gives an empty result.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("v"), low.alias("u")).distinct())
    seen = _state(now)
    while seen[0]:
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = cut(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")))
        # v's neighbours above it hang on v's least
        large = cut(both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct())
        below = cut(large.groupBy("v").agg(F.min("u").alias("m")))
        hung = large.join(below, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        following = cut(hung.union(below.select("v", F.col("m").alias("u"))).distinct())
        for gone in (now, least, large, below):
            drop(gone)
        now = following
        if (state := _state(now)) == seen:
            break
        seen = state
    roots = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    own = now.select(F.col("u").alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    return roots.union(own.select("node", F.col("node").alias("root")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
