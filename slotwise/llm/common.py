"""What the training-data operators share: their input tables, lineage cuts, ranks, sieves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.ranking import ranked
from slotwise.sources.shared import cut, drop, scratch, shared_dir

#: Words of 64 bits in a sieve at most, each a row that is broadcast.
SIEVE_WORDS = 1 << 19

__all__ = ["Sieve", "arrow_map", "cut", "documents", "drop", "keep_rows", "labels", "private", "ranked", "scratch", "shared_dir", "ship"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors, once a session, so that their Python workers can
    import what the functions sent to them refer to, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_slotwise_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    at = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{package.name}-package.zip")
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    sc.addPyFile(at)
    sc._slotwise_shipped = True


def arrow_map(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` of a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def private(columns: list[str]) -> Callable[[str], str]:
    """Names of an operator's own columns, none of which is in ``columns``."""
    prefix = "_own_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return lambda name: prefix + name


class Sieve:
    """Parts rows that may have one of ``hashes.h`` from those that can't, without moving them.

    One bit in 16 or more is set, as long as ``SIEVE_WORDS`` words hold so many; beyond that
    more rows pass that need not. A row that has one of the hashes always passes, so what an
    exact join is to find among all rows, it finds among those that passed. Hashes must be
    well mixed and not null. ``keep``: as in ``cut``.
    """

    def __init__(self, hashes: DataFrame, keep: bool = False):
        self.words = min(SIEVE_WORDS, 1 << (hashes.count() // 4).bit_length())
        word, bit = self._place(F.col("h"))
        self.table = cut(hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), keep=keep)

    def _place(self, h: Column) -> tuple[Column, Column]:
        top = F.shiftrightunsigned(h, 58).cast("int")
        return h.bitwiseAND(F.lit(self.words - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), top)

    def parted(self, rows: DataFrame, h: Column) -> tuple[DataFrame, DataFrame]:
        """The ``rows`` whose ``h`` may be one of the hashes, and the others."""
        own = private(rows.columns)
        word, bit = self._place(h)
        table = F.broadcast(self.table.select(F.col("word").alias(own("word")), F.col("bits").alias(own("bits"))))
        on = (word == F.col(own("word"))) & (F.col(own("bits")).bitwiseAND(bit) != 0)
        return rows.join(table, on, "left_semi"), rows.join(table, on, "left_anti")


def keep_rows(docs: DataFrame, kept: DataFrame, repeated: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose id and text are in ``kept`` (id, h).

    h is xxhash64 of the text (null as empty); null ids match each other. The rows are moved
    once, by id and hash. If ``repeated``, rows of the same id and text come out once. Columns
    of ``docs`` may have any names.
    """
    own = private(docs.columns)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = docs.withColumns({own("id"): F.col(f"`{id_col}`").cast("long"), own("h"): F.xxhash64(text)})
    wanted = kept.select(F.col("id").alias(own("kept_id")), F.col("h").alias(own("kept_h")))
    found = keys.join(wanted, F.col(own("id")).eqNullSafe(F.col(own("kept_id"))) & (F.col(own("h")) == F.col(own("kept_h"))), "left_semi")
    if repeated:
        found = found.dropDuplicates([own("id"), own("h")])
    return found.drop(own("id"), own("h"))
