"""Exact dedup by content sort, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, private

#: Text bytes of one range, about.
RANGE_BYTES = 16 << 20
#: What a row counts for beside its bytes, and the leading characters that splitters look at.
ROW_BYTES, LEADING = 64, 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Sampled splitters deal the texts into ranges of about ``range_bytes``, by their leading
    characters, and among texts that begin alike by a hash, which bounds what sampling
    collects. An external sort by the whole text puts equals side by side; a run ends where a
    row's whole text differs from its neighbour's. Size and largest identifier of a group are
    those of its run. Only a text too heavy for one task has several runs, by row; their
    heads, one row each, meet by the whole text again.

    Texts are equal when identical, after ``normalise`` if there is one. A null text counts as
    empty. A null doc_id is smaller than any other: a group of null doc_ids only has a null
    keep_id. Ties: of rows with the same doc_id and text exactly one is ``kept``, the first
    read. A very long text is one row of one range, compared in full. An empty table gives an
    empty result; other columns of ``docs`` are ignored, whatever their names. ``docs`` must
    read alike when it is read again, as a table does.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    dealt, own, k, total, _ = _dealt(narrow, "id", "t", range_bytes, normalise)
    found = cut(
        _runs(dealt, own, k, total, range_bytes).select(
            F.col("id").alias("doc_id"),
            F.col(own("keep")).alias("keep_id"),
            F.col(own("n")).alias("group_size"),
            F.col(own("head")).alias("kept"),
            F.sha2(own("key"), 256).alias("text_sha256"),
            F.col(own("row")).alias("row"),
            F.col(own("heavy")).alias("heavy"),
            F.when(F.col(own("heavy")) & F.col(own("head")), F.col(own("key"))).alias("key"),
        )
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    whole = found.where("NOT heavy").select(columns)
    merged = cut(_merged(found.where("heavy AND kept"), "key", "keep_id", "row", "group_size").select(F.sha2("key", 256).alias("text_sha256"), "best", "n"))
    parts = found.where("heavy").select("doc_id", "text_sha256", "row").join(merged, "text_sha256")
    return whole.union(parts.select("doc_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_dedup`` keeps: one for each distinct text.

    Rows move once, whole, in the content sort, and the head of each run goes out. Only the
    heads of texts too heavy for one task are cut to a table, where they meet again. Nulls,
    ties, repeated rows, very long texts and empty tables are as in ``exact_dedup``; columns
    keep their names, types and order, whatever the names.
    """
    dealt, own, k, total, heavy = _dealt(docs, id_col, text_col, range_bytes, normalise)
    text = F.when(~F.col(own("null")), F.col(f"`{text_col}`"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    bulk = heavy.agg(F.sum("b")).first()[0] or 0
    light = _runs(dealt.where(~F.col(own("heavy"))), own, k, total - bulk, range_bytes).where(own("head")).select(columns)
    if not bulk:
        return light
    heads = cut(_runs(dealt.where(own("heavy")), own, k, bulk, range_bytes).where(own("head")))
    best = _merged(heads, own("key"), own("keep"), own("row"), own("n"))
    best = cut(best.select(F.col("best.row").alias(own("best"))))
    return light.union(heads.join(best, F.col(own("row")) == F.col(own("best")), "left_semi").select(columns))


def _dealt(docs: DataFrame, id_col: str, text_col: str, range_bytes: int, normalise: Callable[[Column], Column] | None) -> tuple[DataFrame, Callable[[str], str], str, int, DataFrame]:
    """The rows of ``docs``, the text without nulls, and columns named by the second result:
    id, null, row, heavy, and p, h and s, by which ranges are dealt. Then the column that is
    compared, the bytes of all texts, and (h, b), the bytes of each heavy one."""
    own = private(docs.columns)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = normalise(text) if normalise else text
    hashed = docs.select(F.xxhash64(key).alias("h"), (F.octet_length(key) + ROW_BYTES).cast("long").alias("b"))
    sizes = cut(hashed.groupBy("h").agg(F.sum("b").alias("b")))
    total = sizes.agg(F.sum("b")).first()[0] or 0
    # what one task may hold of one text; texts of more are at most 2^20, or 2^10 in small tables
    most = max(1, total >> 20, min(range_bytes // 4, total >> 10))
    heavy = sizes.where(F.col("b") > most)
    parts = heavy.select(F.col("h").alias(own("h")), F.ceil(F.col("b") / most).alias(own("parts")))
    named = {text_col: text, own("null"): F.col(f"`{text_col}`").isNull(), own("id"): F.col(f"`{id_col}`").cast("long"), own("row"): F.monotonically_increasing_id(), own("h"): F.xxhash64(key)}
    rows = docs.withColumns(named | ({own("text"): key} if normalise else {}))
    k = own("text") if normalise else f"`{text_col}`"
    dealt = rows.join(F.broadcast(parts), own("h"), "left")
    part = F.when(F.col(own("parts")).isNotNull(), F.pmod(F.xxhash64(own("row")), own("parts"))).otherwise(0)
    dealt = dealt.withColumns({own("p"): F.substring(k, 1, LEADING), own("s"): part, own("heavy"): F.col(own("parts")).isNotNull()}).drop(own("parts"))
    return dealt, own, k, total, heavy


def _runs(dealt: DataFrame, own: Callable[[str], str], k: str, total: int, range_bytes: int) -> DataFrame:
    """``dealt`` in sorted ranges, with columns named by ``own``: key (what is compared), head,
    keep and n (of the run). ``total``: bytes of its texts."""
    ranges = [own("p"), own("h"), own("s")]
    run = Window.partitionBy(*ranges, k).orderBy(F.col(own("id")).desc_nulls_last(), own("row"))
    every = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_ = dealt.repartitionByRange(max(1, -(-total // range_bytes)), *ranges)
    found = {own("head"): F.row_number().over(run) == 1, own("keep"): F.first(own("id")).over(every), own("n"): F.count(F.lit(1)).over(every)}
    return sorted_.withColumns(found).withColumn(own("key"), F.col(k))


def _merged(heads: DataFrame, key: str, keep: str, row: str, n: str) -> DataFrame:
    """(key, best (id, row), n) of each text with several runs, from the heads of the runs."""
    best = F.max(F.struct(F.col(keep).alias("id"), (-F.col(row)).alias("row")))
    found = heads.groupBy(F.col(key).alias("key")).agg(best.alias("best"), F.sum(n).alias("n"))
    return found.select("key", F.struct("best.id", (-F.col("best.row")).alias("row")).alias("best"), "n")


#: DuckDB SQL for the result over ``documents``.
ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
