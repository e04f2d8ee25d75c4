import random
import zlib

import numpy as np
import pytest
from slotwise.llm import quality, toxicity
from slotwise.llm.queries import op1_quality, op10_toxicity

from .conftest import sentence

DATA = "/root/testdata/sf0.01"


def _toy(spark, bad):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        text, y = sentence(rng, 60), i % 2
        rows.append((i, bad(text) if y else text))
        labels.append((i, y, 1 - y))
    labels += [(None, 1, 1), (5000, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def _held(i, count, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % count == rest


def test_quality_learns(spark):
    docs, labels = _toy(spark, lambda t: t.upper() + " $$$ ###")
    out = quality.quality_scores(docs, labels).collect()
    assert all(r["held_out"] == _held(r["doc_id"], 4, 2) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    held = [r["predicted"] == (r["doc_id"] + 1) % 2 for r in out if r["held_out"]]
    assert sum(held) / len(held) > 0.98


def test_toxicity_learns(spark):
    docs, labels = _toy(spark, lambda t: t + " zorbling idiot")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r["held_out"] == _held(r["doc_id"], 3, 1) for r in out)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out if r["held_out"])
    assert toxicity.without_toxic(docs, labels).count() == 200


def test_held_out_labels_are_not_read(spark):
    docs, labels = _toy(spark, lambda t: t + " zorbling")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    scores = lambda f, y: sorted((r["doc_id"], r["score"]) for r in f(docs, y).collect())
    assert scores(toxicity.toxicity_scores, labels) == scores(toxicity.toxicity_scores, flipped)
    assert scores(quality.quality_scores, labels) == scores(quality.quality_scores, flipped)


@pytest.mark.parametrize("query,label,least", [(op1_quality, "quality", 0.97), (op10_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    out = query(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50
    assert np.mean([r["predicted"] == r[label] for r in out]) >= least


def test_hard_rows(spark, hard, hard_rows, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(120)], "doc_id long, toxic int, quality int")
    none = labels.limit(0)
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert sorted(str(r["doc_id"]) for r in f(hard, labels).collect()) == sorted(str(i) for i, _ in hard_rows)
        assert {r["score"] for r in f(hard, none).collect()} == {0.5}
        assert f(empty, labels).count() == 0
    assert toxicity.without_toxic(hard, none).columns == hard.columns


def test_neighbours_by_brute_force():
    rng = random.Random(1)
    counts = np.stack([quality.terms(sentence(rng, 50).upper() if i % 3 else sentence(rng, 50)) for i in range(90)])
    labels = np.array([float(i % 3 == 0) for i in range(90)])
    model = quality.Model(counts[:60], labels[:60], 8)
    got = model.score(counts[60:])
    x = model._unit(model._weighed(counts[60:]) @ model.directions)
    for v, s in zip(x, got):
        cosine = np.maximum(model.vectors @ v, 0)
        top = np.sort(cosine)[::-1][: quality.NEIGHBOURS]
        w = cosine**quality.SHARPNESS * (cosine >= top[-1])
        assert s == pytest.approx((w * model.labels).sum() / w.sum(), abs=1e-3)


def test_label_model_by_brute_force():
    """Expectation maximisation written out by row and voter, without arrays."""
    rng = random.Random(5)
    truth = [rng.random() < 0.3 for _ in range(300)]
    chance = [(0.7, 0.02), (0.6, 0.05), (0.5, 0.01), (0.2, 0.2)]
    votes = [[int(rng.random() < (hit if y else miss)) for hit, miss in chance] for y in truth]
    votes = [v + [1 if sum(v) > 1 else 0 if any(v) else -1] for v in votes]
    model = toxicity.LabelModel(np.array(votes, np.int8), 0.3, rounds=4)
    n, post = len(votes[0]), [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.3 for v in votes]
    for _ in range(4):
        acc = []
        for j in range(n):
            cast = [(v[j], p) for v, p in zip(votes, post) if v[j]]
            acc.append(min(0.999, max(0.05, (sum(p if x > 0 else 1 - p for x, p in cast) + 4) / (len(cast) + 5))))
        rates = [[(sum(w for v, w in zip(votes, ws) if v[j]) + 0.5) / (sum(ws) + 1) for j in range(n)] for ws in (post, [1 - p for p in post])]
        cov = lambda j, k: sum(w * ((v[j] != 0) - r[j]) * ((v[k] != 0) - r[k]) for ws, r in ((post, rates[0]), ([1 - p for p in post], rates[1])) for v, w in zip(votes, ws))  # noqa: B023, E731
        share = []
        for j in range(n):
            corr = [1 if j == k else min(1, max(0, cov(j, k) / (cov(j, j) * cov(k, k)) ** 0.5)) for k in range(n)]
            share.append(1 / sum(c * c for c in corr))
        post = [1 / (1 + np.exp(-(sum(x * s * np.log(a / (1 - a)) for x, a, s in zip(v, acc, share)) + np.log(0.3 / 0.7)))) for v in votes]
    assert model.accuracy == pytest.approx(acc, abs=1e-6) and model.share == pytest.approx(share, abs=1e-5)
    assert model.posterior == pytest.approx(post, abs=1e-5)
    assert model.accuracy[0] > 0.85 > model.accuracy[3]  # the voter at random is found out


def test_toxicity_query_by_brute_force(spark):
    """The query's scores, recomputed row by row from the model that it fitted."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    voters, linear = toxicity.fit(docs, labels, "toxic", (3, 1))
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {}
    for i, text in texts:
        found = {x for w in set(toxicity._WORD.findall((text or "").lower())) for x in toxicity.features(w)} & set(voters.names)
        votes = [float(x in found) for x in voters.names]
        votes += [float(len(found & {f"={w}" for w in toxicity.LEXICON}) > 1), 1.0 if len(found) > 1 else 0.0 if found else -1.0]
        want[i] = 1 / (1 + np.exp(-(np.dot(votes, linear.weights[:-1]) + linear.weights[-1])))
    for r in op10_toxicity(spark, DATA).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-5) and r["predicted"] == (r["score"] >= 0.7)


def test_needed_voters():
    matched = [[0, 2, 3]] * 6 + [[2, 3]] * 4 + [[4]] * 4 + [[5]] * 6 + [[5]] * 3
    toxic = np.array([True] * 20 + [False] * 3)
    assert toxicity.needed(matched, toxic, 2) == [2, 3, 5]


def test_quality_query_by_brute_force(spark):
    """The query's scores, from cosines of one document at a time."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, "quality", (4, 2))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in op1_quality(spark, DATA).collect():
        x = np.log1p(quality.terms(texts[r["doc_id"]]).astype(np.float64)) * model.weight
        x = x / max(np.linalg.norm(x), 1e-12) @ model.directions
        cosine = np.maximum(model.vectors @ (x / max(np.linalg.norm(x), 1e-12)), 0)
        near = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        w = cosine[near] ** quality.SHARPNESS
        assert r["score"] == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=0.02)
