"""The quality model comes from all labelled rows and all their pairs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isolume.llm import quality


def labelled(n=600, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.random((n, len(quality.FEATURES)))
    return x, ((x[:, 3] + 0.2 * x[:, 5] + 0.3 * draw.standard_normal(n)) > 0.6).astype(int)


def test_model_is_that_of_all_pairs():
    """Against Newton's method on every pair, written out; the threshold leaves as many scores below it as there are zeros."""
    x, label = labelled()
    model = quality.learn(x, label)
    z = (quality.expand(x) - model["mean"]) / model["scale"]
    diff = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-diff @ w))
        w -= np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 1e-3 * np.eye(len(w)), diff.T @ (p - 1) / len(diff) + 1e-3 * w)
    assert np.abs(w - model["w"]).max() < 1e-3
    raw = np.sort(z @ model["w"])
    assert model["threshold"] == pytest.approx(raw[(label == 0).sum() - 1 : (label == 0).sum() + 1].mean())
    assert model["spread"] == pytest.approx(raw.std())


def test_ties_constant_features_and_rows_labelled_twice():
    x, label = labelled(80)
    x[:, 2] = 0.25
    twice = quality.learn(np.concatenate([x, x]), np.concatenate([label, label]))
    double = quality.fit(lambda f, op=np.add: f(x, 2.0 * (label == 1), 2.0 * (label == 0)))
    assert twice["w"] == pytest.approx(double["w"], abs=1e-6) and twice["threshold"] == pytest.approx(double["threshold"])
    same = quality.learn(np.ones((6, len(quality.FEATURES))), np.array([0, 1, 0, 1, 1, 0]))
    assert np.isfinite(quality.score(np.ones((2, len(quality.FEATURES))), same)).all()
    assert quality.learn(x, np.ones(80, int)) is None


def test_every_labelled_row_teaches(spark):
    """More rows than the 20,000 that were drawn before, in whatever partitions."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.hex("id"), F.repeat(F.lit("!"), (F.col("id") % 5).cast("int"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 5 < 3).cast("int").alias("quality"))
    rows = quality.learned_rows(docs, labels)
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60_000))
    parts = [quality.fit(quality._over(rows.repartition(n))) for n in (1, 7)]
    table = rows.toPandas()
    whole = quality.learn(np.array(table["features"].tolist()), table["good"].to_numpy().astype(int))
    for model in parts:
        assert model["w"] == pytest.approx(whole["w"], abs=1e-6) and model["threshold"] == pytest.approx(whole["threshold"], abs=1e-6)
    got = quality.score_documents(docs.filter("doc_id < 500"), labels).select("doc_id", "score").collect()
    assert len(got) == 500
