"""Packing of token pieces by bounded-space best fit."""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import arrow_map, cut

#: Bins that are open at a time.
OPEN_BINS = 128
#: Bytes of text encoded at a time; words that a worker remembers; characters of such a word.
SLICE_BYTES, KNOWN, LONG_WORD = 4 << 20, 200_000, 64

#: A blank amid or after other white space, where a text can't be cut before every blank; and
#: the blanks where it can be then.
_AMID, _AFTER = re.compile(r"\s (?:\s|\Z)"), re.compile(r"(?<=\S) ")
#: Where engines of patterns might differ: beyond Latin-1, and in long runs of white space.
_FAR = re.compile(r"[^\x00-\xff]|\s{256}")
# Fixed value: the splitting pattern of byte-level vocabularies.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BestFit:
    """Online best fit over a fixed number of open bins.

    Open bins stand under their free space, and a bitset has a bit for each free space that
    some bin has, so the tightest bin that fits is its lowest bit from the piece's size up.
    A full bin closes; a new bin beyond the bound closes the fullest open one, the lowest bit
    of all (``closed`` counts these).
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = self.closed = 0

    def _take(self, free: int) -> int:
        found = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def add(self, size: int) -> tuple[int, int]:
        """(bin, place in it) of a piece of ``size``."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most:
                self.closed += 1
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_, self.made = self.capacity, self.made, self.made + 1
        left = free - size
        if left:
            self.at[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


class Encoder:
    """The ids of whole texts as the tokenizers library gives them, each text's as
    little-endian unsigned 32-bit numbers.

    A byte-level vocabulary splits texts by a fixed pattern, which no piece crosses between
    anything and a blank, but where the blank stands amid other white space. Texts are cut
    there, and the library encodes each distinct word (with its blank) once while it is
    remembered. Texts of Latin-1 go whole through tiktoken, where the vocabulary is proven to
    give the same ids there (``_ranked``). A text that holds an added token, or any text of a
    tokenizer of another kind, goes to the library whole.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec.get("pre_tokenizer") or {}
        self.by_words = spec.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex") is True and not step.get("add_prefix_space") and not spec["model"].get("dropout")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}
        self.ranked = _ranked(spec, self.library) if self.by_words else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, cut, plain, firsts, whole = self.known, {}, {}, {}, {}
        if len(known) > KNOWN:
            known.clear()
        new: set[str] = set()
        for i, t in enumerate(texts):
            if not self.by_words or any(x in t for x in self.added):
                whole[i] = t
                continue
            if self.ranked and not _FAR.search(t):
                plain[i] = t
                continue
            firsts[i], *rest = _AFTER.split(t) if _AMID.search(t) else t.split(" ")
            cut[i] = rest
            new.update(set(rest).difference(known))
        words = list(new)
        known.update(zip(words, self._ids([f" {w}" for w in words])))
        out = dict(zip(whole, self._ids(list(whole.values())))) | dict(zip(firsts, self._ids(list(firsts.values()))))
        out |= {i: array("I", self.ranked(t)).tobytes() for i, t in plain.items()}
        for i, rest in cut.items():
            out[i] += b"".join(map(known.__getitem__, rest))
        for w in words:
            if len(w) > LONG_WORD:
                del known[w]
        return [out[i] for i in range(len(texts))]


def _ranked(spec: dict, library) -> Callable[[str], list[int]] | None:
    """tiktoken's encoding by ids as ranks, where it is the library's by merges; else None.

    It is if ids rise with merges and every piece comes out of its own bytes as itself. For
    let ranks merge x and y, the lowest pair, into z. No merge has crossed the ends of z, so
    inside all lower merges are done as they are for z alone, which leaves the one pair that
    is listed for z: that pair is x and y.
    """
    merges, vocab, special = spec["model"].get("merges"), spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens") or []}
    if not merges or spec["model"].get("type") != "BPE":
        return None
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    pieces = [x for x in vocab if x not in special]
    if made != sorted(set(made)) or any([t.value for t in library.model.tokenize(x)] != [x] for x in pieces):
        return None
    import tiktoken

    # a printable byte is written as itself, any other as a character from 256 up
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    if any(c not in to_byte for x in pieces for c in x) or not set(to_byte) <= set(pieces):
        return None
    ranks = {bytes(to_byte[c] for c in x): vocab[x] for x in pieces}
    return tiktoken.Encoding("by ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one, or full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the end id."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(SLICE_BYTES, batch["t"].nbytes)))
            for at in range(0, batch.num_rows, step):
                x, rows = batch.slice(at, step), []
                for doc_id, ids in zip(x["doc_id"].to_pylist(), encode([t or "" for t in x["t"].to_pylist()])):
                    ids = memoryview(ids + end)
                    for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                columns = zip(*rows) if rows else [[]] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return arrow_map(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and the end id are one piece, or, if longer than ``capacity``, full
    pieces after a first that may be shorter. The pieces are written to a table, and each
    partition of it is packed online, in the order in which it is read: a piece goes to the
    fullest open sequence that takes it, and ``open_bins`` sequences are open at a time. So
    nothing is shuffled, no id or length can be hot, and a task's state is bounded; what a
    task leaves open at its end is all that more tasks cost.

    A null text is empty: its one piece is the end id. A very long text is encoded whole, in
    one task, and cut. Ties of free space go to the sequence that came to it last. Repeated
    rows are packed as often as they come; null doc_ids come out as they come in; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    pieces = cut(token_pieces(docs, path, capacity, end_id, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        for x in batches:
            placed = [bins.add(n) for n in x["length"].to_pylist()]
            base = [p << 40 for p in x["task"].to_pylist()]
            new = [pa.array([b + i for b, (i, _) in zip(base, placed)], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], *new], names=[*x.schema.names[:-1], "sequence_id", "offset"])

    kept = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.spark_partition_id().alias("task"))
    return arrow_map(kept, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
