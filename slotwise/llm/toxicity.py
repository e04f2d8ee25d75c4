"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut
from .quality import fold_of

#: Bound of the fit: labelled texts.
FIT_ROWS = 20_000
#: A mined voter is in so many unlike toxic texts at least, and so rarely in others.
SUPPORT, PRECISION = 5, 0.9
#: A mined voter is left out where it adds fewer than SUPPORT toxic texts to those that so many
#: others match already.
DEPTH = 3
#: Words that a worker remembers.
_SEEN = 100_000
#: A document is taken to be toxic from this score up.
TOXIC = 0.7

# The lexicon of abuse, in English, German, French and Spanish.
LEXICON = (
    *("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "hate", "ugly", "shut", "jerk", "fool", "garbage"),
    *("idioten", "trottel", "dummkopf", "versager", "abschaum", "ekelhaft", "erbärmlich", "wertlos"),
    *("idiote", "imbécile", "crétin", "racaille", "ordure", "minable", "dégoûtant", "débile"),
    *("idiota", "imbécil", "estúpido", "escoria", "asqueroso", "patético", "perdedor", "inútil"),
)

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    """The patterns that a word matches: itself, and its beginnings."""
    return [f"={word}", *(f"{word[:n]}*" for n in _PREFIXES if len(word) > n)]


class Voters:
    """Lexicon words and mined patterns, each of which votes for toxic where it matches, and
    two that count matches: several lexicon words; several voters, which votes against if
    there is none."""

    def __init__(self, mined: Iterable[str]):
        self.names = [*(f"={w}" for w in LEXICON), *sorted(set(mined) - {f"={w}" for w in LEXICON})]
        self.index = {x: i for i, x in enumerate(self.names)}
        self.size = len(self.names) + 2
        self.seen: dict[str, tuple[int, ...]] = {}

    def matched(self, text: str | None) -> set[int]:
        """The voters, by index, that match a whole text."""
        seen, found = self.seen, set()
        for word in words_of(text):
            if (hit := seen.get(word)) is None:
                if len(seen) > _SEEN:
                    seen.clear()
                hit = seen[word] = tuple(i for x in features(word) if (i := self.index.get(x)) is not None)
            if hit:
                found.update(hit)
        return found

    def votes(self, text: str | None) -> np.ndarray:
        """1 for toxic, -1 against, 0 for none."""
        return self.votes_of(self.matched(text))

    def votes_of(self, found: set[int]) -> np.ndarray:
        out = np.zeros(self.size, np.int8)
        if found:
            out[list(found)] = 1
            out[-2] = sum(i < len(LEXICON) for i in found) > 1
        out[-1] = 1 if len(found) > 1 else 0 if found else -1
        return out


class LabelModel:
    """A generative model of votes given a hidden label, fitted to the votes alone.

    A voter that votes is right with an accuracy of its own; silence says nothing. Expectation
    maximisation starts at the majority of the votes and estimates accuracies from where each
    voter agrees with what all together say. Voters that go together within a class more than
    chance has it (their correlation) share their weight. ``prior`` is the share of toxic texts.
    """

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 10):
        self.prior = float(np.clip(prior, 0.01, 0.99))
        on = (votes != 0).astype(np.float64)
        total = votes.sum(axis=1)
        posterior = np.where(total > 0, 0.9, np.where(total < 0, 0.1, self.prior))
        for _ in range(rounds):
            right = np.where(votes > 0, posterior[:, None], 1 - posterior[:, None]) * on
            self.accuracy = np.clip((right.sum(axis=0) + 4) / (on.sum(axis=0) + 5), 0.05, 0.999)  # 0.8 without any vote
            self.share = self._shared(on, posterior)
            posterior = self.posterior_of(votes)
        self.posterior = posterior

    def _shared(self, on: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """By voter: one over the voters that it amounts to together with."""
        excess = np.zeros((on.shape[1],) * 2)
        spread = np.zeros(on.shape[1])
        for w in (posterior, 1 - posterior):
            part = (on - (w @ on + 0.5) / (w.sum() + 1)) * np.sqrt(w)[:, None]
            excess += part.T @ part
            spread += (part**2).sum(axis=0)
        spread = np.sqrt(spread) + 1e-9
        correlation = np.clip(excess / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(correlation, 1)
        return 1 / (correlation**2).sum(axis=0)

    def posterior_of(self, votes: np.ndarray) -> np.ndarray:
        weight = np.log(self.accuracy / (1 - self.accuracy)) * self.share
        return 1 / (1 + np.exp(-np.clip(votes @ weight + np.log(self.prior / (1 - self.prior)), -30, 30)))


class Linear:
    """Logistic regression on the votes, fitted to the label model's posteriors."""

    def __init__(self, votes: np.ndarray, target: np.ndarray, steps: int = 25, ridge: float = 0.1):
        x = np.concatenate([votes.astype(np.float64), np.ones((len(votes), 1))], axis=1)
        self.weights = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(steps if len(x) else 0):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (p - target) + penalty * self.weights
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, votes: np.ndarray) -> np.ndarray:
        return votes @ self.weights[:-1] + self.weights[-1]

    def calibrated(self, votes: np.ndarray, labels: np.ndarray) -> Linear:
        """With slope and offset of the logit, which alone see ``labels``, fitted to them."""
        x = np.stack([self.logit(votes), np.ones(len(votes))], axis=1)
        start = np.array([1.0, 0.0])
        loss = lambda at: np.logaddexp(0, x @ at).sum() - labels @ (x @ at) + ((at - start) ** 2).sum() / 2
        at = start.copy()
        for _ in range(50):  # Newton's method, with steps that are halved until they help
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - labels) + at - start)
            while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
                step /= 2
            at = at - step
            if np.abs(step).max() < 1e-6:
                break
        self.weights *= at[0]
        self.weights[-1] += at[1]
        return self

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(votes), -30, 30)))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def mine(sample: DataFrame) -> list[str]:
    """All patterns that tell toxic texts of ``sample`` (id, label, t) by SUPPORT and PRECISION.

    Each counts unlike texts only: of those of one signature, the least hash of their words,
    which are likely near copies, one counts (a toxic one if there is any, then the least id).
    Tasks count, so that a row for each pattern and task is all that moves; patterns of toxic
    texts come first, and the others are asked for these alone.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for x in batches:
            least = [min((xxhash.xxh64_intdigest(w) >> 1 for w in words_of(t)), default=0) for t in x["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([x["id"], x["label"], pa.array(least, pa.int64())], names=["id", "label", "signature"])

    def counted(known: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            for x in batches:
                for text in x["t"].to_pylist():
                    own = {f for w in words_of(text) for f in features(w)}
                    found.update(own if known is None else own & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["x", "n"])

        return run

    signatures = arrow_map(sample.select("id", "label", "t"), signed, "id long, label double, signature long")
    one = signatures.groupBy("signature").agg(F.min(F.struct((-F.col("label")).alias("order"), "id")).alias("first"))
    unlike = cut(sample.join(F.broadcast(one.select(F.col("first.id").alias("id"))), "id").select("label", "t"))  # FIT_ROWS ids at most
    number = lambda texts, known: arrow_map(texts.select("t"), counted(known), "x string, n long").groupBy("x").agg(F.sum("n").alias("n"))
    # all that is collected is of at most FIT_ROWS texts
    toxic = {r["x"]: r["n"] for r in number(unlike.where("label > 0.5"), None).where(F.col("n") >= SUPPORT).collect()}
    clean = {r["x"]: r["n"] for r in number(unlike.where("label <= 0.5"), set(toxic)).collect()}
    return sorted(x for x, n in toxic.items() if n >= PRECISION * (n + clean.get(x, 0)))


def needed(matched: list[list[int]], toxic: np.ndarray, first: int) -> list[int]:
    """Of the voters from ``first`` on, those that add to what the others match: by falling
    number of toxic texts (ties: the lower index), one is taken if it matches SUPPORT of them
    that fewer than DEPTH taken ones match. ``matched`` has each text's voters."""
    texts: dict[int, list[int]] = {}
    for i in np.flatnonzero(toxic):
        for v in matched[i]:
            if v >= first:
                texts.setdefault(v, []).append(i)
    depth, taken = np.zeros(len(matched), np.int64), []
    for v in sorted(texts, key=lambda v: (-len(texts[v]), v)):
        own = np.array(texts[v])
        if (depth[own] < DEPTH).sum() >= SUPPORT:
            taken.append(v)
            depth[own] += 1
    return taken


def fit(docs: DataFrame, labels: DataFrame, label_col: str, fold: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> tuple[Voters, Linear]:
    """Voters and classifier from at most ``rows`` labelled texts outside the held-out fold. Of
    several texts with one id, the least is taken.

    Labels choose patterns, give the share of toxic texts, and calibrate. What a voter's vote
    is worth comes from the label model, which sees votes only.
    """
    count, held = fold
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(fold_of("id", count) != held).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(known), "id")  # ``rows`` rows at most
    texts = texts.groupBy("id", "label").agg(F.min("t").alias("t"))
    sample = cut(texts.select("id", "label", "t"))
    voters = Voters(mine(sample))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = pa.array([sorted(voters.matched(t)) for t in x["t"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([x["id"], x["label"], found], names=["id", "label", "matched"])

    got = arrow_map(sample, match, "id long, label double, matched array<int>").toArrow().sort_by([("id", "ascending")])
    label, matched = got["label"].to_numpy(), got["matched"].to_pylist()
    if not len(label):
        return Voters([]), Linear(np.zeros((0, len(LEXICON) + 2), np.int8), np.empty(0))
    kept = Voters(voters.names[v] for v in needed(matched, label > 0.5, len(LEXICON)))
    place = {v: kept.index[x] for v, x in enumerate(voters.names) if x in kept.index}
    votes = np.stack([kept.votes_of({place[v] for v in m if v in place}) for m in matched])
    model = LabelModel(votes, label.mean())
    return kept, Linear(votes, model.posterior).calibrated(votes, label)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fold: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", toxic: float = TOXIC) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Voters are the lexicon and patterns mined from a bounded set of labelled texts. A label
    model estimates their accuracies and correlations from their votes and weighs these into
    posterior labels, which a linear classifier learns. Its weights, one a voter, are
    broadcast, and every whole text is scored, however long it is.

    A null text is empty; no voter matches it. A null doc_id is in the fold of the empty text.
    Without any label, scores are a half. Ties in the fit go to the least id, text or pattern.
    Repeated rows come out as they come in; other columns are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    rows = rows.select("doc_id", (fold_of("doc_id", fold[0]) == fold[1]).alias("held_out"), "t")
    score = _scorer(docs, labels, label_col, fold, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["held_out"], score(x["t"])], names=["doc_id", "held_out", "score"])

    scored = arrow_map(rows, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= toxic).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fold: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", toxic: float = TOXIC) -> DataFrame:
    """The rows of ``docs``, whole, that score below ``toxic``: nulls, empty and very long
    texts, repeated rows and empty tables as in ``toxicity_scores``; columns keep their names,
    whatever these are."""
    score = _scorer(docs, labels, label_col, fold, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(score(x[text_col]).to_numpy() < toxic))

    return arrow_map(docs, run, docs.schema)


def _scorer(docs: DataFrame, labels: DataFrame, label_col: str, fold: tuple[int, int], id_col: str, text_col: str):
    voters, linear = fit(docs, labels, label_col, fold, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast((voters, linear))

    def score(texts: pa.Array) -> pa.Array:
        voters, linear = model.value
        votes = np.zeros((len(texts), voters.size), np.float32)
        for i, t in enumerate(texts):
            votes[i] = voters.votes(t.as_py())
        return pa.array(linear.score(votes), pa.float64())

    return score
