"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Bounds of the fit: labelled texts, and dimensions of the latent space. The labelled vectors
#: that are broadcast take FIT_ROWS * DIMENSIONS * 4 bytes, whatever the input.
FIT_ROWS, DIMENSIONS = 4096, 48
#: Neighbours that vote, and the power of the cosine that weighs a vote.
NEIGHBOURS, SHARPNESS = 25, 16
#: Documents whose cosines with all labelled vectors are held at a time.
BLOCK = 512
#: A document is taken to be good from this score up.
GOOD = 0.7

# Classes of bytes: letters, capitals, digits, blanks, line ends, and marks by kind.
_CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[0x80:] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _k, _marks in ((3, b" \t"), (4, b"\n\r"), (5, b"."), (6, b","), (7, b"!?"), (8, b"|")):
    _CLASS[list(_marks)] = _k
_SHAPES = _CLASSES**3
_RUNS, _LINES, _SIZES = 24, 16, 24
TERMS = _SHAPES + _RUNS + _LINES + _SIZES


def terms(text: str | None) -> np.ndarray:
    """Counts of a whole text's terms: triples of byte classes (runs of letters as one),
    lengths of letter runs, how often its lines repeat, and its size."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(TERMS, np.float32)
    out[_SHAPES + _RUNS + _LINES + min(len(raw).bit_length(), _SIZES - 1)] = 1
    if not len(raw):
        return out
    kind = _CLASS[raw]
    starts = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] > 2)]))
    kept = kind[starts].astype(np.int64)
    if len(kept) > 2:
        out[:_SHAPES] = np.bincount(kept[:-2] * _CLASSES**2 + kept[1:-1] * _CLASSES + kept[2:], minlength=_SHAPES)
    lengths = np.diff(starts, append=len(raw))[kept < 2]
    out[_SHAPES : _SHAPES + _RUNS] = np.bincount(np.minimum(lengths, _RUNS - 1), minlength=_RUNS)
    lines = text.split("\n")
    repeated = 1 - len(set(lines)) / len(lines)
    out[_SHAPES + _RUNS + int(repeated * (_LINES - 1))] = len(lines)
    return out


class Model:
    """Latent-semantic vectors: logarithmic counts, weighed by rarity, on the leading
    directions of the labelled texts; with the labelled texts' own vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = self._weighed(counts)
        _, directions = np.linalg.eigh(x.T @ x)
        self.directions = directions[:, ::-1][:, :dimensions].astype(np.float32)
        self.vectors = self._unit(x @ self.directions)

    def _weighed(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.weight)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The labels of the nearest labelled vectors, weighed by a power of their cosine."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = np.maximum(self._unit(self._weighed(counts) @ self.directions) @ self.vectors.T, 0)
        k = min(NEIGHBOURS, len(self.labels))
        # ties at the last place go to the labelled text that comes first
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        above = cosine > last
        tied = (cosine == last) & (np.cumsum(cosine == last, axis=1) <= k - above.sum(axis=1, keepdims=True))
        near = np.nonzero(above | tied)[1].reshape(len(cosine), k)
        weight = np.take_along_axis(cosine, near, axis=1).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), self.prior)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for at in range(0, x.num_rows, BLOCK):
            part = x.slice(at, BLOCK)
            yield pa.RecordBatch.from_arrays([part["label"], pa.array([terms(t).tobytes() for t in part["t"].to_pylist()], pa.binary())], names=["label", "counts"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str, fold: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """A model of at most ``rows`` labelled texts: those of the smallest hashes among the labels
    outside the held-out fold. Null labels and ids are no labels; of several texts with one id,
    the least is taken."""
    count, held = fold
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(fold_of("id", count) != held).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(known), "id")  # ``rows`` rows at most
    texts = texts.groupBy("id", "label").agg(F.min("t").alias("t"))
    found = arrow_map(texts.select("label", "t"), _counts, "label double, counts binary").toArrow()
    counts = np.frombuffer(b"".join(found["counts"].to_pylist()), np.float32).reshape(-1, TERMS)
    label = found["label"].to_numpy()
    order = np.lexsort([*counts.T[::97], label])  # whatever order the tasks end in
    return Model(counts[order], label[order])


def fold_of(id_col: str, count: int):
    """crc32 of the id as text, modulo ``count``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(count))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fold: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", good: float = GOOD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A bounded set of labelled texts is fitted; its vectors and labels are broadcast, and every
    document's exact cosines with all of them are computed in blocks. The NEIGHBOURS nearest
    vote. Only the text is scored, the whole of it.

    A null text is empty, and has a vector of its own. A very long text is counted whole, in
    arrays of a few bytes a character. Ties for the last place among the neighbours go to the
    labelled text that comes first. A null doc_id is in the fold of the
    empty text. Without any label, scores are a half. Repeated rows come out as they come in;
    other columns are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, fold, id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts, found = x["t"], []
            for at in range(0, x.num_rows, BLOCK):
                found.append(model.value.score(np.stack([terms(t) for t in texts.slice(at, BLOCK).to_pylist()])))
            scores = np.clip(np.concatenate(found or [np.empty(0)]), 0, 1)
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["held_out"], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    rows = rows.select("doc_id", (fold_of("doc_id", fold[0]) == fold[1]).alias("held_out"), "t")
    scored = arrow_map(rows, score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= good).cast("int"))
