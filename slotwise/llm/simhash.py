"""SimHash near-dedup by a segment-popcount embedding and a grid join under Manhattan distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, arrow_map, cut, keep_rows, scratch
from .components import components

#: A fingerprint has 32 segments of two bits; a segment's bit count is one coordinate.
SEGMENTS = 32
_EVEN = 0x5555555555555555
#: Members of a grid cell that one task compares at a time.
BLOCK = 1024
#: Links that a task holds before it reduces them to a forest.
_EDGES_HELD = 1_000_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of each word shingle, in order, repeats included.

    Words are runs of anything but ASCII white space, A-Z lower-cased; fewer words than a
    shingle are one shingle; no words give none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    return np.array([digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits: bit i is set if over half of ``hashes`` have it."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounds what a very long text holds
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The majority of the hashes of the word shingles; no words give zero."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp): one row per row of ``docs``; h is the text's xxhash64 (null as empty),
    fp the fingerprint, as signed 64-bit numbers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = np.array([fingerprint(t, shingle) for t in x["t"].to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["h"], pa.array(found)], names=["doc_id", "h", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return arrow_map(rows.select("doc_id", F.xxhash64("t").alias("h"), "t"), of, "doc_id long, h long, fp long")


def embedded(fp: Column) -> Column:
    """The 32 segment bit counts of ``fp``, each in two bits of unary code (none 00, one 01,
    two 11): the Manhattan distance of two embeddings is the bit count of their XOR, and is
    never above the Hamming distance of the fingerprints."""
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(F.lit(_EVEN)).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(_EVEN)), 1))


def grid_masks(distance: int) -> list[int]:
    """Masks over the embedding, one for each projection of the grid.

    The coordinates are cut into ``2 * distance`` bands (at least four). Two points within
    Manhattan distance ``distance`` differ in at most so many bands, so they share a cell in
    some projection onto the other bands.
    """
    bands = max(4, 2 * distance)
    edges = [round(i * SEGMENTS / bands) for i in range(bands + 1)]
    band = [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(band, bands - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as a-b do: at most one for each node."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(before, label):
            own = np.flatnonzero(label != np.arange(n))
            return own, label[own]


def _compare(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (g, side, fp, e) come sorted by g; out go links within each g, as a forest.

    side 0: the row is compared with every later row of its g. side 1 and 2: with the rows of
    the other side alone (two blocks of a large cell). Groups may be cut anywhere by batches,
    so the rows of the last group are carried over; a group has at most two blocks' rows.
    """

    def linked(g: np.ndarray, side: np.ndarray, fp: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, held, size = len(g), [], 0
        alive, lag = np.arange(n), 1
        while len(alive):
            alive = alive[alive + lag < n]
            alive = alive[g[alive] == g[alive + lag]]
            i, j = alive, alive + lag
            near = np.bitwise_count(e[i] ^ e[j]) <= distance
            i, j = i[near], j[near]
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & ((side[i] == 0) | (side[i] != side[j]))
            held.append((i[near], j[near]))
            size += int(near.sum())
            if size > _EDGES_HELD:
                held = [forest(n, *(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
            lag += 1
        if not size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i, j = forest(n, *(np.concatenate(x) for x in zip(*held)))
        return fp[i].view(np.int64), fp[j].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        names = ("g", "side", "fp", "e")
        for x in batches:
            now = [x[c].to_numpy(zero_copy_only=False) for c in names]
            now = [c.view(np.uint64) if k in ("fp", "e") else c for k, c in zip(names, now)]
            if rest is not None:
                now = [np.concatenate(c) for c in zip(rest, now)]
            if not len(now[0]):
                continue
            at = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on in the next batch
            rest = [c[at:] for c in now]
            a, b = linked(*(c[:at] for c in now))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if rest is not None:
            a, b = linked(*rest)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(fps: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fps.fp`` just as all pairs within
    ``distance`` bits do, without writing out the pairs of a dense group.

    Each fingerprint goes to one cell in every projection of the grid. A cell of over
    ``block`` members is cut into blocks by hash, and each pair of blocks is a group of its
    own, so that no cell is one task's; all pairs of blocks are compared. A block grows with
    the root of its cell, so a cell of n members makes n^1.5 rows at most, never n^2.
    """
    masks = F.array(*(F.lit(m) for m in grid_masks(distance)))
    points = fps.select("fp", embedded(F.col("fp")).alias("e"))
    cells = points.select("fp", "e", F.posexplode(masks).alias("k", "mask")).select("fp", "e", F.xxhash64("k", F.col("e").bitwiseAND(F.col("mask"))).alias("cell"))
    # two cells of one hash would only be compared for nothing; a table of its own, so that the
    # join is between two exchanges and a large cell's rows can be split
    sizes = cut(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = in_blocks(cells.join(sizes, "cell"), "fp", block_count(F.col("n"), block))
    groups = shared.select("g", "side", "fp", "e").repartition("g").sortWithinPartitions("g")
    return arrow_map(groups, _compare(distance), "a long, b long").distinct()


def block_count(n: Column, block: int) -> Column:
    """Blocks of a cell of ``n`` members: of ``block`` members, and of more, in proportion to
    the root of n, where n is large, so that a member is in at most sqrt(n / block) pairs."""
    return F.ceil(n / F.greatest(F.lit(block), F.sqrt(n * block))).cast("int")


def in_blocks(members: DataFrame, member: str, blocks: Column) -> DataFrame:
    """``members`` (cell, ...) by pairs of blocks of their cells, with g and side: a row for each
    pair that its block is in. side is 0 where a block is paired with itself, else 1 or 2."""
    placed = members.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64(member, F.lit("block")), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    return pairs.withColumns({"g": F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")), "side": side}).drop("blocks", "i", "j")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in ``distance`` bits or fewer;
    component_id is the smallest doc_id reachable. Copies meet by fingerprint before any
    comparison, so a group of equal fingerprints costs one row.

    Null and empty texts have fingerprint zero and link like any other. A very long text is
    hashed whole, in bounded parts. A bit that exactly half of the hashes have is not set; equal
    fingerprints (ties) are one point of the grid. A row with a null
    doc_id takes part; it is in no minimum (component_id is null if all are null). Repeated
    rows come out as often as they come in. Other columns are ignored; an empty table gives
    an empty result.
    """
    found = _grouped(docs, id_col, text_col, shingle, distance)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs``, whole, one of each group: that of the smallest doc_id (a null one
    if there is no other; of several texts with that doc_id, the one of the smallest hash)."""
    with scratch(docs.sparkSession):
        return one_of_each(docs, cut(_grouped(docs, id_col, text_col, shingle, distance).select("doc_id", "h", "root")), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, whole, that are the first of their root in ``found`` (doc_id, h, root).
    A row alone in its group stays where it is; the others, and those that a sieve of their
    hashes lets pass beside them, are moved once. The result reads tables that are kept beyond
    the caller's ``scratch``, and not ``found``."""
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("h").alias("h")))
    groups = cut(found.groupBy("root").agg(first.alias("x"), F.count(F.lit(1)).alias("n")))
    several = cut(found.join(groups.where("n > 1").select("root"), "root", "left_semi").select("doc_id", "h"))
    again = several.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = not again.isEmpty() or not several.where("doc_id IS NULL").isEmpty()
    sieve = Sieve(several, keep=True)
    kept, _ = sieve.parted(groups.select("x.id", "x.h"), F.col("h"))
    passed, alone = sieve.parted(docs, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return alone.union(keep_rows(passed, cut(kept, keep=True), repeated, id_col, text_col))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, h, fp, root (its group), component_id."""
    found = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct, distance))
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = cut(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))
    return found.join(member, "fp").select("doc_id", "h", "fp", "root", "component_id")
