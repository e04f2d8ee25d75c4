"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Bytes of text of one chunk, about; a document is in one chunk.
CHUNK_BYTES = 32 << 20
#: Words whose ids are put together at a time.
SLICE_WORDS = 400_000


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def _pieces(path: str) -> tuple[pa.Array, pa.Array]:
    """By id: the decimal id, and the piece."""
    t = tokenizer(path)
    size = max(t.get_vocab(with_added_tokens=True).values()) + 1
    return pa.array([str(i) for i in range(size)], pa.large_string()), pa.array([t.id_to_token(i) or "" for i in range(size)], pa.large_string())


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``texts``, end to end, and the number of each text's.

    Words are what ASCII white space parts: no normalisation, pre-tokenizer pattern or special
    token reaches across it. A text of Latin-1 alone that holds no ``<|`` is lower-cased
    first, which the tokenizer would do to each word, so that fewer words are distinct.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, r"[^\x{00}-\x{ff}]|<\|")
    split = pc.ascii_split_whitespace(pc.if_else(odd, texts, pc.utf8_lower(texts)))
    flat = split.flatten()
    held = pc.not_equal(flat, "")
    ends = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    return flat.filter(held), np.diff(ends[np.concatenate([[0], np.cumsum(lengths)])])


def _lower_cases(path: str) -> bool:
    return "x" == (n.normalize_str("X") if (n := tokenizer(path).normalizer) else "")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """(chunk, doc_ids, words of each document, the distinct words, each word's place in them).

    Places are by falling frequency (ties: first seen), so that most are small. Both readings
    of the documents make the same chunks, since the same partitions come in the same order.
    """
    chunk = TaskContext.get().partitionId() << 24
    for x in batches:
        step = max(1, int(x.num_rows * CHUNK_BYTES / max(CHUNK_BYTES, x["t"].nbytes)))
        for at in range(0, x.num_rows, step):
            part = x.slice(at, step)
            flat, n = words_of(part["t"])
            coded = flat.dictionary_encode()
            place = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(-np.bincount(place, minlength=len(coded.dictionary)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            yield chunk, part["doc_id"], n, coded.dictionary.take(pa.array(order)), rank[place]
            chunk += 1


def _hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.array([digest(w) for w in words.to_pylist()], np.uint32)


def _check(hashes: np.ndarray) -> np.ndarray:
    """A byte of each word's hash; the other bytes choose the word's bucket."""
    return (hashes & 255).astype(np.uint8)


def _packed(**columns) -> bytes:
    """Columns of one length, compressed; a column of numbers as planes of their bytes, since
    one byte of all numbers together packs best."""
    flat = {}
    for name, c in columns.items():
        if isinstance(c, np.ndarray):
            flat |= {f"{name}{s}": pa.array((c >> s).astype(np.uint8)) for s in (0, 8, 16, 24)}
        else:
            flat[name] = c
    batch, sink = pa.RecordBatch.from_arrays(list(flat.values()), names=list(flat)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return sum(table[f"{name}{s}"].to_numpy().astype(np.int32) << s for s in (0, 8, 16, 24))


def _runs(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, where it is), for each value."""
    order = np.argsort(of, kind="stable")
    values, starts = np.unique(of[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, starts[1:]))


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)]


def _distinct(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each chunk and bucket: the chunk's distinct words of the bucket, with places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["bucket", "chunk", "words"], [pa.int32(), pa.int64(), pa.binary()]
        for chunk, _, _, words, _ in _chunks(batches):
            bucket = (_hashes(words) >> 8) % buckets
            rows = [(b, chunk, _packed(word=words.take(pa.array(at)), place=at)) for b, at in _runs(bucket)]
            yield pa.RecordBatch.from_arrays(_rows(rows, names, types), names=names)

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its documents as places in its distinct words."""
    for chunk, doc_id, n, words, place in _chunks(batches):
        row = [(chunk, _packed(doc_id=doc_id, n=pa.array(n, pa.int64())), _packed(place=place), _check(_hashes(words)).tobytes())]
        names = ["chunk", "docs", "places", "checks"]
        yield pa.RecordBatch.from_arrays(_rows(row, names, [pa.int64(), *[pa.binary()] * 3]), names=names)


def _encode(path: str) -> Callable[[pa.Table], pa.Table]:
    """One bucket of words: each distinct one is encoded once, and its ids go to all chunks
    that have it."""

    def run(bucket: pa.Table) -> pa.Table:
        t = tokenizer(path)
        parts = [_unpacked(x) for x in bucket["words"].to_pylist()]
        coded = pa.concat_tables(parts)["word"].combine_chunks().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids: list[list[int]] = []
        for at in range(0, len(words), 2048):
            ids += [e.ids for e in t.encode_batch_fast(words[at : at + 2048], add_special_tokens=False)]
        size, checks = np.array([len(x) for x in ids], np.int64), _check(_hashes(coded.dictionary))
        start, flat = np.concatenate([[0], np.cumsum(size)]), np.array([i for x in ids for i in x], np.int64)
        row, rows, lo = coded.indices.to_numpy(zero_copy_only=False), [], 0
        for chunk, part in zip(bucket["chunk"].to_pylist(), parts):
            own = row[lo : lo + part.num_rows]
            lo += part.num_rows
            entries = _packed(place=_numbers(part, "place"), size=size[own], check=pa.array(checks[own]))
            rows.append((chunk, entries, _packed(id=_gathered(flat, start, size, own))))
        names = ["chunk", "entries", "ids"]
        return pa.Table.from_arrays(_rows(rows, names, [pa.int64(), pa.binary(), pa.binary()]), names=names)

    return run


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The stretches ``rows`` of ``flat``, end to end."""
    n = size[rows]
    ends = np.cumsum(n)
    return flat[np.repeat(start[rows] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _together(path: str, schema: str, finish) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One chunk's documents and its words' ids, by place: the result of each document."""
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        checks = np.frombuffer(b"".join(chunks["checks"].to_pylist()), np.uint8)
        parts = [_unpacked(x) for x in found["entries"].to_pylist()]
        join = lambda xs, kind: np.concatenate([np.empty(0, kind), *xs])
        place = join([_numbers(x, "place") for x in parts], np.int64)
        order = np.argsort(place)
        seen = join([x["check"].to_numpy() for x in parts], np.uint8)[order]
        if chunks.num_rows != 1 or not np.array_equal(place[order], np.arange(len(checks))) or not np.array_equal(seen, checks):
            raise RuntimeError("the documents were dealt differently when they were read again; write them to a table first")
        size = join([_numbers(x, "size") for x in parts], np.int64)
        start = np.cumsum(size) - size
        size, start = size[order], start[order]
        flat = join([_numbers(_unpacked(x), "id") for x in found["ids"].to_pylist()], np.int32)
        docs, at = _unpacked(chunks["docs"][0].as_py()), _numbers(_unpacked(chunks["places"][0].as_py()), "place")
        ends = np.concatenate([[0], np.cumsum(docs["n"].to_numpy())])
        out, lo = [], 0
        while lo < docs.num_rows:  # a few documents at a time, or one long one
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_WORDS, "right")) - 1)
            words = at[ends[lo] : ends[hi]]
            done = np.concatenate([[0], np.cumsum(size[words])])
            ids = _gathered(flat, start, size, words)
            out.append(pa.Table.from_arrays([docs["doc_id"].slice(lo, hi - lo).combine_chunks(), *finish(ids, done[ends[lo : hi + 1] - ends[lo]], path)], names=names))
            lo = hi
        return pa.concat_tables(out)

    return run


def _strings(ids: np.ndarray, ends: np.ndarray, path: str) -> list[pa.Array]:
    """Of each text, its decimal ids and its pieces, joined by spaces: two joins on the id."""
    offsets, space, at = pa.array(ends, pa.int64()), pa.scalar(" ", pa.large_string()), pa.array(ids, pa.int32())
    return [pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.take(by_id, at)), space) for by_id in _pieces(path)]


def _whole(ids: np.ndarray, ends: np.ndarray, path: str) -> list[pa.Array]:
    parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
    return [pa.array(parts, pa.binary()), _strings(ids, ends, path)[1].cast(pa.string())]


def _digests(ids: np.ndarray, ends: np.ndarray, path: str) -> list[pa.Array]:
    sha = lambda texts: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())
    return [pa.array(np.diff(ends), pa.int64()), *map(sha, _strings(ids, ends, path))]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (little-endian unsigned 32-bit, as binary),
    decoded (the ids' pieces, joined as the tokenizer's decode does). See ``_assembled``."""
    return _assembled(docs, path, id_col, text_col, "ids binary, decoded string", _whole)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256: as
    ``encode_decode``, with the digests made where ids and text are. See ``_assembled``."""
    return _assembled(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _assembled(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, finish) -> DataFrame:
    """Split, encode the distinct words, join the ids back by position.

    Documents are read in chunks. The distinct words of each chunk, with their places, go to
    buckets by hash, where the tokenizers library encodes each distinct word once; a word has
    one entry for each chunk at most, so no word is hot. Its ids go back to the chunks, which
    meanwhile hold their documents as places, and every position gets its word's ids. Ids are
    decoded by a join with the vocabulary's pieces.

    The result is the library's for the whole text, special tokens included. Documents are
    read twice and must then come in the same partitions, as from a table; a byte of every
    word's hash is compared, and a difference is an error.

    Null texts are empty and have no ids. A very long text is a chunk of its own. Ties of words'
    frequencies go to the word seen first, and no result depends on them. Repeated rows and null doc_ids come out as they come
    in; other columns are ignored; an empty table gives an empty result.
    """
    if tokenizer(path).decoder is not None or not _lower_cases(path):
        raise ValueError("made for a tokenizer that lower-cases and has no decoder, so that pieces are joined by spaces")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    # a bucket then holds about as many words as a partition of the input has distinct ones, at most
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    words = arrow_map(rows, _distinct(buckets), "bucket int, chunk long, words binary")
    # as many tasks as the documents have, or more: what a task gathers doesn't grow with the input
    found = words.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_encode(path), "chunk long, entries binary, ids binary")
    chunks = arrow_map(rows, _documents, "chunk long, docs binary, places binary, checks binary")
    chunks, found = chunks.repartition(buckets, "chunk"), found.repartition(buckets, "chunk")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_together(path, schema, finish), f"doc_id long, {schema}")
