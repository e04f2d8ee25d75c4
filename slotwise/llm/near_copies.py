"""Near copies by five-word shingles: candidates from the fingerprints' grid and from MinHash
bands, each checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Sieve, arrow_map, cut, scratch
from .components import components

#: Words in a shingle, and the least Jaccard similarity of the shingle sets of near copies.
SHINGLE = 5
JACCARD = 0.8
#: Bits in which the fingerprints of a candidate pair of the grid differ at most.
DISTANCE = 3
#: Two texts are candidates too if all minima of a band agree. At a similarity of 0.8 a pair
#: has no such band with probability (1 - 0.8^5)^24, under 1 in 10,000.
BANDS, IN_BAND = 24, 5
#: Members of a cell, and bytes of their shingle sets, that a task compares at a time; rows and
#: shingles of one product of matrices.
BLOCK, BLOCK_BYTES = 1024, 64 << 20
_TILE, _COLUMNS = 512, 4096

_random = np.random.default_rng(42)
_FACTOR = _random.integers(0, 1 << 64, BANDS * IN_BAND, dtype=np.uint64) | np.uint64(1)
_TERM = _random.integers(0, 1 << 64, BANDS * IN_BAND, dtype=np.uint64)
_MIX = _random.integers(0, 1 << 64, (BANDS, IN_BAND), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles of a whole text, sorted; no words are one."""
    found = simhash.shingle_hashes(text, shingle)
    return np.unique(found) if len(found) else np.zeros(1, np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of minima of ``found``, as signed 64-bit numbers."""
    least = np.full(BANDS * IN_BAND, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):  # bounds what a very long text holds
        least = np.minimum(least, (found[at : at + 1024, None] * _FACTOR + _TERM).min(axis=0))
    return ((least >> np.uint64(7)) * _MIX.reshape(-1)).reshape(BANDS, IN_BAND).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, jaccard: float = JACCARD) -> bool:
    """Whether two results of ``shingles`` have at least that Jaccard similarity."""
    low, high = sorted((len(a), len(b)))
    if low < jaccard * high:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (low + high - common) >= jaccard


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members any two of ``sets`` have in common, exactly: products of matrices that
    have a row for each set and a column for each member that several sets have."""
    n, sizes = len(sets), [len(x) for x in sets]
    member, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    kept = times[column] > 1
    row, column = np.repeat(np.arange(n), sizes)[kept], shared[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column, out = row[order], column[order], np.zeros((n, n), np.float32)
    for first in range(0, int(shared[-1]) + 1, _COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _COLUMNS])
        held = np.zeros((n, min(_COLUMNS, int(shared[-1]) + 1 - first)), np.float32)
        held[row[lo:hi], column[lo:hi] - first] = 1
        out += held @ held.T
    return out


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """The rows of ``docs``, whole, one of each group of near copies: that of the smallest
    doc_id (a null one if there is no other; of several texts with that doc_id, the one of the
    smallest hash; of rows with the same doc_id and text, any one).

    Texts link when the Jaccard similarity of their shingle sets is at least ``jaccard``;
    groups are what links connect. Null and empty texts and texts without words link with each
    other, and so do equal texts.

    Candidates come from two sources. Fingerprints of the shingles go through the grid join
    of ``simhash``; texts whose sets share a MinHash band meet in a cell, which finds pairs at
    ``jaccard`` whose fingerprints are far apart. First, each text is checked against the
    least of its cell, which joins a large group of near copies by one check a text. Then the
    members of cells that still hold different groups are compared in blocks, all of them,
    without writing pairs out. Only links that the sets of the whole texts confirm count.
    Texts move if they are candidates, whole rows if their group has others, and of the rest
    the few that a sieve lets pass.

    A very long text is hashed in bounded parts, and its set (8 bytes a word) is one value. An
    empty table gives an empty result. Columns keep their names, whatever these are.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            hashes = [simhash.shingle_hashes(t, shingle) for t in x["t"].to_pylist()]
            prints = np.array([simhash.majority(v) for v in hashes], np.uint64).view(np.int64)
            keys = [bands(np.unique(v) if len(v) else np.zeros(1, np.uint64)) for v in hashes]
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            listed = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["h"], pa.array(prints), listed], names=["doc_id", "h", "fp", "keys"])

    with scratch(docs.sparkSession):  # only the table of kept rows outlives this
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
        found = cut(arrow_map(rows, of, "doc_id long, h long, fp long, keys array<long>"))
        distinct = cut(found.select("h", "fp", "keys").dropDuplicates(["h"]))

        # by fingerprint: texts of one fingerprint with the least of them, and that with those near
        prints = cut(distinct.groupBy("fp").agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("n")))
        same = distinct.join(prints.where("n > 1").select("fp", "least"), "fp").select(F.col("least").alias("a"), F.col("h").alias("b"))
        least = prints.select("fp", F.col("least").alias("h"))
        near = cut(simhash.links(prints.select("fp"), DISTANCE))
        near = near.join(least.toDF("a", "ha"), "a").join(least.toDF("b", "hb"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))

        # by band
        cells = distinct.select("h", F.posexplode("keys").alias("k", "key")).select("h", F.xxhash64("k", "key").alias("cell"))
        # a table of its own, so that the join is between two exchanges and a large cell's rows can be split
        sizes = cut(cells.groupBy("cell").agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        shared = cut(cells.join(sizes, "cell"))
        pairs = shared.select(F.col("least").alias("a"), F.col("h").alias("b")).union(same).union(near).where("a <> b")
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        wanted = cut(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
        passed, _ = Sieve(wanted).parted(rows.select("h", "t"), F.col("h"))  # only these move
        sets = cut(_sets(passed.join(wanted, "h", "left_semi").dropDuplicates(["h"]), shingle))
        links = cut(_confirmed(pairs, sets, jaccard))

        grouped = cut(shared.join(components(links).withColumnRenamed("node", "h"), "h", "left").select("cell", "h", F.coalesce("root", "h").alias("root")))
        weighed = grouped.join(sets.select("h", F.octet_length("s").alias("b")), "h")
        mixed = weighed.groupBy("cell").agg((F.min("root") != F.max("root")).alias("mixed"), F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
        mixed = cut(mixed.where("mixed").select("cell", "n", "b"))
        blocks = F.greatest(simhash.block_count(F.col("n"), BLOCK), F.ceil(F.col("b") / BLOCK_BYTES).cast("int"))
        members = cut(simhash.in_blocks(grouped.join(mixed, "cell"), "h", blocks).select("g", "side", "h", "root"))
        compared = members.join(sets, "h").select("g", "side", "h", "root", "s").repartition("g").sortWithinPartitions("g")
        links = links.union(cut(arrow_map(compared, _compare(jaccard), "a long, b long").distinct()))

        joined = components(links).withColumnRenamed("node", "h")
        member = found.select("doc_id", "h").join(joined, "h", "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))
        return simhash.one_of_each(docs, cut(member), id_col, text_col)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(h, s): the shingles of each of ``texts`` (h, t), 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                s = pa.array([shingles(t, shingle).tobytes() for t in part["t"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part["h"], s], names=["h", "s"])

    return arrow_map(texts, run, "h long, s binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            near = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), jaccard) for a, b in zip(x["sa"], x["sb"])]
            yield x.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return arrow_map(joined.select("a", "b", "sa", "sb"), run, "a long, b long")


def _compare(jaccard: float):
    """Rows (g, side, h, root, s) come sorted by g; out go links between similar members of
    each g, as a forest. Members of one root are linked already; two of a side other than 0
    are compared elsewhere. A group may be cut anywhere by batches, and is held whole."""

    def linked(side: np.ndarray, h: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, held = len(h), []
        tiles = [np.arange(at, min(at + _TILE, n)) for at in range(0, n, _TILE)]
        for k, one in enumerate(tiles):
            for other in tiles[k:]:
                at = one if other is one else np.concatenate([one, other])
                size = np.array([len(sets[i]) for i in at], np.float32)
                both = common_counts([sets[i] for i in at])
                near = np.triu(both >= np.float32(jaccard * (1 - 1e-6)) * (size[:, None] + size - both), 1)
                i, j = np.nonzero(near)
                i, j = at[i], at[j]
                kept = (root[i] != root[j]) & ((side[i] == 0) | (side[i] != side[j]))
                held += [(a, b) for a, b in zip(i[kept], j[kept]) if similar(sets[a], sets[b], jaccard)]
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = simhash.forest(n, *np.array(held).T)
        return h[a], h[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

        def of(rows: list) -> tuple[np.ndarray, np.ndarray]:
            _, side, h, root, sets = zip(*rows)
            return linked(np.array(side), np.array(h), np.array(root), list(sets))

        for x in batches:
            columns = [x[c].to_pylist() for c in ("g", "side", "h", "root")]
            for row in zip(*columns, (np.frombuffer(s.as_py(), np.uint64) for s in x["s"])):
                if rest and rest[0][0] != row[0]:
                    if len(rest) > 1:
                        yield out(of(rest))
                    rest = []
                rest.append(row)
        if len(rest) > 1:
            yield out(of(rest))

    return run
