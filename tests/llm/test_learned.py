"""Language ID, quality scores, top-k search: held-out accuracy, gradients, brute force, odd rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isolume.llm import lang_id, quality, topk
from isolume.llm.lang_id import identify
from isolume.llm.quality import score_documents
from isolume.llm.topk import top_k

WORDS = {"en": "the of and that with from house water", "fr": "le la des une dans être maison où", "de": "der die und nicht über haus größe"}


def corpus(spark, n=240):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(WORDS))
        words = [rnd.choice(WORDS[lang].split()) for _ in range(rnd.randint(8, 90))]
        good = rnd.random() < 0.7
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), lang, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def out_of_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_id(spark, monkeypatch):
    docs = corpus(spark)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in identify(docs.select("doc_id", "text", "lang")).collect()}
    held = [i for i in truth if out_of_fold(i)]
    assert len(held) > 20 and np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_of_odd_rows(spark, odd, nothing):
    got = identify(odd.select("doc_id", "text", "lang"), corpus(spark)).collect()
    assert len(got) == 10
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 3, 8))
    assert all(r.lang_pred in WORDS for r in got if r.doc_id in (1, 5, 9))
    alone = identify(odd.select("doc_id", "text", "lang"), nothing).collect()
    assert {r.lang_pred for r in alone} == {"und"} and identify(nothing.select("doc_id", "text", "lang")).count() == 0


def test_gradients_of_the_network():
    """Backpropagation through time against differences."""
    draw = np.random.default_rng(0)
    n = lang_id.HIDDEN
    x = draw.integers(97, 101, (6, 3)).astype(np.uint8)
    table, u = draw.standard_normal((256, 3 * n)) * 0.5, draw.standard_normal((n, 3 * n)) * 0.5
    pull = draw.standard_normal((6, 3, n))

    def loss():
        return sum((k[-1] * p).sum() for k, p in zip(lang_id._run(x, table, u), pull, strict=True))

    d_table, d_u = lang_id._back(x, lang_id._run(x, table, u), u, pull)
    for a, d, at in ((u, d_u, (1, 2)), (u, d_u, (3, 2 * n + 1)), (table, d_table, (98, n)), (table, d_table, (99, 2 * n))):
        old, h = a[at], 1e-3
        a[at] = old + h
        up = loss()
        a[at] = old - h
        down = loss()
        a[at] = old
        assert d[at] == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=1e-3)


def test_batched_inference_equals_one_text_at_a_time():
    draw = np.random.default_rng(1)
    shapes = {"table_f": (256, 24), "u_f": (8, 24), "table_b": (256, 24), "u_b": (8, 24), "head": (16, 3), "bias": (3,)}
    p = {k: draw.standard_normal(s).astype(np.float32) for k, s in shapes.items()}
    texts = ["abc", "", "d" * 300, "é" * 64, "xyz" * 43]
    got = lang_id.document_probabilities(pa.array(texts), p)
    for t, q in zip(texts, got, strict=True):
        raw, total = t.encode(), np.zeros(3)
        for a in range(0, len(raw), lang_id.SEGMENT):
            x = np.frombuffer(raw[a : a + lang_id.SEGMENT], np.uint8)[:, None]
            f, b = lang_id._run(x, p["table_f"], p["u_f"]), lang_id._run(x[::-1], p["table_b"], p["u_b"])[::-1]
            z = np.concatenate([np.stack([k[-1][0] for k in f]), np.stack([k[-1][0] for k in b])], axis=1) @ p["head"] + p["bias"]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
        assert q == pytest.approx(total / max(len(raw), 1), abs=1e-4)


def test_quality(spark):
    docs = corpus(spark)
    labels = docs.select("doc_id", "quality").filter("doc_id % 3 <> 0")
    truth = {r.doc_id: r.quality for r in docs.collect()}
    got = {r.doc_id: r.score for r in score_documents(docs.select("doc_id", "text"), labels).collect()}
    assert np.mean([(got[i] >= 0.3) == truth[i] for i in truth if out_of_fold(i) or i % 3 == 0]) > 0.97
    assert min(got[i] for i in truth if truth[i]) > max(got[i] for i in truth if not truth[i])


def test_quality_of_odd_rows(spark, odd, nothing):
    docs = corpus(spark)
    labels = docs.select("doc_id", "quality")
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    got = score_documents(both, labels).collect()
    assert len(got) == 250 and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert {r.score for r in score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert score_documents(odd, labels.limit(0)).columns == [*odd.columns, "score"]
    assert score_documents(nothing, labels).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 7)], "doc_id long, quality int")
    assert {r.score for r in score_documents(odd, nulls).collect()} == {0.5}


def test_columns_named_like_results_are_replaced(spark, odd):
    docs = corpus(spark)
    named = odd.withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit("old"))
    got = identify(named.select("doc_id", "text", "lang", "score", "lang_pred", F.lit(7).alias("__letters")), docs)
    assert got.columns == ["doc_id", "__letters", "lang_pred", "score"] and dict(got.dtypes)["score"] == "double"
    got = score_documents(named, docs.select("doc_id", "quality"))
    assert sorted(got.columns) == sorted(named.columns) and dict(got.dtypes)["score"] == "double"


def test_fitting_is_bounded_and_the_same_each_time(spark):
    """Rows that all repeat a doc_id: twice the sample at most, whatever the order of the rows."""
    one = next(i for i in range(9) if not out_of_fold(i))
    docs = spark.createDataFrame([(one, f"text number {i}", "en") for i in range(500)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(one, 1)], "doc_id long, quality int")
    windows = [lang_id.training_windows(docs.repartition(n), sample=10)[0] for n in (1, 4)]
    assert 0 < len(windows[0]) <= 20 * lang_id.WINDOWS and (windows[0] == windows[1]).all()
    fitted = [quality.training_rows(docs.repartition(n), labels, sample=10)[0] for n in (1, 4)]
    assert fitted[0].shape[0] == 20 and (fitted[0] == fitted[1]).all()


def test_pairwise_loss_ranks():
    draw = np.random.default_rng(2)
    x = draw.random((400, len(quality.FEATURES)))
    label = (x[:, 3] + 0.2 * x[:, 5] > 0.6).astype(int)
    s = quality.score(x, quality.learn(x, label))
    assert np.mean((s >= quality.THRESHOLD) == label) > 0.93


def brute(rows, k, every):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    floors = [[math.floor(64 * x) for x in v] for _, v in ok]
    out = []
    for n, (i, _) in enumerate(ok):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(floors[n], floors[m], strict=False)), j) for m, (j, _) in enumerate(ok) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("least", [1024, 5])
def test_top_k(spark, monkeypatch, least):
    """In one block, and in many that share their queries' bounds."""
    monkeypatch.setattr(topk, "LEAST", least)
    monkeypatch.setattr(topk, "MOST", least)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) * 0.9**d for d in range(40)]) for i in range(120)]
    rows += [(7, rows[7][1]), (20, rows[20][1]), (200, [0.0] * 40), (201, None), (None, [1.0] * 40), (202, [None] * 40), (203, [float("nan")] * 40), (204, [float("inf")] * 40), (205, [1.0, 2.0]), (220, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, row string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, k=5, every=10).collect())
    assert got == brute(rows, 5, 10)


def test_top_k_of_few_and_large(spark):
    df = spark.createDataFrame([(20, [1e12, 1.0]), (1, [3e12, -2.0]), (2, [-1e12, 5.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in top_k(df, k=20).collect()]
    assert sorted(got) == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]
    assert top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [1024, 8])
def test_top_k_orders_large_products(spark, monkeypatch, least):
    """Products beyond 2**53 differ by less than a float tells apart."""
    monkeypatch.setattr(topk, "LEAST", least)
    monkeypatch.setattr(topk, "MOST", least)
    rows = [(20, [2.0**28, 1.0])] + [(100 + i, [2.0**28, float(i)]) for i in range(1, 40) if (100 + i) % 20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in top_k(df, k=5, scale=1).collect())
    want = sorted(((2**56 + i - 100, i) for i, _ in rows[1:]), reverse=True)[:5]
    assert got == [(n + 1, i, s) for n, (s, i) in enumerate(want)]


def test_bounds_given_lose_nothing():
    draw = np.random.default_rng(3)
    q, c = np.floor(64 * draw.standard_normal((9, 40))), np.floor(64 * draw.standard_normal((300, 40)))
    ids, own = np.arange(300), np.full(9, -1)
    free = topk.search(q, c, own, ids, 7)
    least = np.array([s[-1] for _, s in free], float)
    for (a, x), (b, y) in zip(free, topk.search(q, c, own, ids, 7, least), strict=True):
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist()
