"""Quality classifier: Bradley-Terry scores from preference pairs.

A text is described by shares of its bytes, words and lines. A text labelled 1
is preferred to one labelled 0; the score is a linear function whose differences
explain the preferences under the logistic loss. The threshold is the quantile
of the training scores that leaves the labels' share of zeros below it; scores
are then mapped to 0..1 so that the threshold lies at 0.3.

Only rows whose doc_id is outside the held-out fold teach, and all of them do:
their features are stored once, and Newton's method passes over that table. The
loss is over all pairs of a good and a bad text. It depends on the scores alone,
so the driver gets sums by stretches of the score: STEP wide for the loss and
its gradient, CELL wide for the curvature, which only steers the steps. Between
stretches it is interpolated, which moves a pair's probability by at most 3e-5.
The threshold is the exact quantile of all training scores.

Defined results: a null text counts as empty and is scored too; without labels
of both kinds every score is 0.5; rows that repeat a doc_id are scored apart; a
null doc_id is not learned from. Columns of docs other than doc_id and text,
and of labels other than doc_id and quality, are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from isolume.llm.common import may_learn, spread, stored
from isolume.llm.textnp import buffers, pieces, shingles, words

#: Widths of the stretches of the score; CELL is a multiple of STEP.
STEP, CELL = 1 / 32, 1 / 4
THRESHOLD = 0.3
AT_ONCE = 4 << 20

#: Kinds of bytes whose shares are features.
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\n\x0b\x0c",
    "stop": b".,;:?'\"-()",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+<>{}[]\\/_`",
}
FEATURES = [*_KINDS, "high", "twice", "again", "word_length", "log_words", "log_line", "short_lines"]


def features(texts: pa.Array) -> np.ndarray:
    """(texts x features): shares in 0..1 but for the last few, which are logarithms and lengths."""
    raw, offsets = buffers(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    doc_of = np.repeat(np.arange(n), size)
    kind = np.zeros(256, np.int64)
    for i, members in enumerate(_KINDS.values()):
        kind[list(members)] = i + 1
    kind[128:] = len(_KINDS) + 1
    wide = len(_KINDS) + 2
    counts = np.bincount(doc_of * wide + kind[raw], minlength=n * wide).reshape(n, wide)[:, 1:]
    out = [counts[:, i] / some for i in range(wide - 1)]

    hashes, before = words(raw, offsets)
    n_words = np.diff(before)
    word_doc = np.repeat(np.arange(n), n_words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    out.append(np.bincount(word_doc, same, n) / np.maximum(n_words, 1))
    doc, shingle = shingles(hashes, before, 5)
    keys = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (shingle >> np.uint64(16)))
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    out.append(np.bincount((keys >> np.uint64(48)).astype(np.int64), again, n) / np.maximum(np.bincount(doc, minlength=n), 1))
    out.append((size - counts[:, 2]) / np.maximum(n_words, 1) / 10)
    out.append(np.log1p(n_words))
    breaks = np.bincount(doc_of[raw == 10], minlength=n)
    out.append(np.log1p(size / (breaks + 1)))
    out.append(np.log1p(breaks) / np.maximum(np.log1p(n_words), 1))
    return np.stack(out, axis=1)


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their square roots (small shares count) and whether they pass a few hundredths."""
    shares = x[:, :10]
    return np.concatenate([x, np.sqrt(shares), shares > 0.03, shares > 0.1], axis=1).astype(np.float64)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(np.diff(buffers(batch.column("text"))[1]), AT_ONCE):
            rows = batch.slice(part.start, part.stop - part.start)
            values = features(rows.column("text")).reshape(-1)
            at = np.arange(rows.num_rows + 1, dtype=np.int32) * len(FEATURES)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(values))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in rows.schema.names if c != "text"], lists], [*[c for c in rows.schema.names if c != "text"], "features"])


def _sums(keys: np.ndarray, values: np.ndarray, op: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    """(keys that occur, the sum, or another reduction, of their values)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], op.reduceat(values, first, axis=0) if len(keys) else values


def _all_sums(tables: list[tuple], op: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    return _sums(np.concatenate([k for k, _ in tables]), np.concatenate([v for _, v in tables]), op)


def _between(s: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The two nodes (numbers of stretches) beside each score, and how much of it is each one's: (2 x scores), (2 x scores)."""
    low = np.floor(s / width)
    part = s / width - low
    return np.stack([low, low + 1]).astype(np.int64), np.stack([1 - part, part])


def _at(s: np.ndarray, width: float, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values at scores, interpolated between nodes."""
    near, part = _between(s, width)
    return (part * values[np.searchsorted(nodes, near)]).sum(axis=0)


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _curvature(x: np.ndarray) -> np.ndarray:
    p = _probability(x)
    return p * (1 - p)


def _pull(good: tuple, bad: tuple, width: float, f: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f(bad's score - good's score) over all bad texts at each good node, and over all good texts at each bad node."""
    (i, m), (j, n) = good, bad
    of_good, of_bad = np.empty(len(i)), np.zeros(len(j))
    for a in range(0, len(i), 256):
        k = f((j[None, :] - i[a : a + 256, None]) * width)
        of_good[a : a + 256] = k @ n
        of_bad += m[a : a + 256] @ k
    return of_good, of_bad


def _raw(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scaled features and raw scores; column by column, so that a text has one score in whatever batch it comes."""
    z = (expand(x) - model["mean"]) / model["scale"]
    out = np.zeros(len(z))
    for column, w in zip(z.T, model["w"], strict=True):
        out += column * w
    return z, out


def _ordered(s: np.ndarray) -> np.ndarray:
    """Integers in the order of floats, and the floats' own bits."""
    bits = (s + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _ranked(each: Callable, model: dict, rank: int) -> float:
    """The score with that many training scores before it, found 12 bits at a time."""
    known, shift = 0, 64
    while shift:
        before, shift = shift, max(shift - 12, 0)

        def count(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple]:
            keys = _ordered(_raw(x, model)[1])
            here = np.ones(len(keys), bool) if before == 64 else (keys >> before) == known  # noqa: B023
            return [_sums(keys[here] >> shift, (good + bad)[here])]  # noqa: B023

        ((keys, n),) = each(count)
        k = int(np.searchsorted(np.cumsum(n), rank, "right"))
        known, rank = int(keys[k]), rank - int(n[:k].sum())
    return float(_ordered(np.array([known]).view(np.float64)).view(np.float64)[0])


def fit(each: Callable, ridge: float = 1e-3) -> dict | None:
    """Weights, scale and threshold; None without both labels.

    each(f, op) goes over all training rows: f(features, times labelled 1, times labelled 0) returns tables of
    (keys, values) for a part of them, and each adds these up (or takes op) by key.
    """

    def zero(values: np.ndarray) -> list[tuple]:
        return [(np.zeros(1, np.int64), values[None, :])]

    ((_, sums),) = each(lambda x, good, bad: zero(np.concatenate([[good.sum(), bad.sum()], (good + bad) @ expand(x)])))
    if not len(sums) or not sums[0, 0] or not sums[0, 1]:
        return None
    n_good, n_bad = sums[0, :2]
    n, n_pairs, mean = n_good + n_bad, n_good * n_bad, sums[0, 2:] / (n_good + n_bad)
    ((_, sums),) = each(lambda x, good, bad: zero((good + bad) @ (expand(x) - mean) ** 2))
    scale = np.sqrt(sums[0] / n)
    model = {"w": np.zeros(len(mean)), "mean": mean, "scale": np.where(scale > 1e-9, scale, 1.0)}

    def by_stretch(s: np.ndarray, width: float, good: np.ndarray, bad: np.ndarray, values: np.ndarray) -> tuple:
        """Sums of values of good (key 2 x node) and bad (key 2 x node + 1) texts."""
        near, part = _between(s, width)
        keys = [2 * k + c for c, t in enumerate((good, bad)) for k in near[:, t > 0]]
        held = [values[t > 0] * (p * t[t > 0])[:, None] for t in (good, bad) for p in part[:, t > 0]]
        return _sums(np.concatenate(keys), np.concatenate(held))

    def halves(table: tuple) -> list[tuple]:
        keys, values = table
        return [(keys[keys % 2 == c] // 2, values[keys % 2 == c]) for c in (0, 1)]

    best, step = np.inf, np.zeros(len(mean))
    for _ in range(60):  # Newton's method on the logistic loss of all pairs; a step that overshoots is halved
        now = dict(model)
        (table,) = each(lambda x, good, bad: [by_stretch(_raw(x, now)[1], STEP, good, bad, np.ones((len(x), 1)))])  # noqa: B023
        good_at, bad_at = [(k, v[:, 0]) for k, v in halves(table)]
        loss = _pull(good_at, bad_at, STEP, lambda d: np.logaddexp(0, d))[0] @ good_at[1] / n_pairs + ridge / 2 * (now["w"] @ now["w"])
        if loss > best + 1e-12:
            step = step / 2
            model["w"] = now["w"] + step
            continue
        best = loss
        if np.abs(step).max() < 1e-6 and step.any():
            break
        of_good, of_bad = _pull(good_at, bad_at, STEP, _probability)
        cells = []
        for k, m in (good_at, bad_at):
            near, part = _between(k * STEP, CELL)
            cells.append(_sums(near.reshape(-1), (part * m).reshape(-1)))
        curved = _pull(*cells, CELL, _curvature)

        def slopes(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple]:
            z, s = _raw(x, now)  # noqa: B023
            pull, curve = np.zeros(len(s)), np.zeros(len(s))
            sides = ((good, -1, good_at[0], of_good, cells[0][0], curved[0]), (bad, 1, bad_at[0], of_bad, cells[1][0], curved[1]))  # noqa: B023
            for times, sign, nodes, force, wide, bend in sides:
                t = times > 0
                pull[t] += sign * times[t] * _at(s[t], STEP, nodes, force)
                curve[t] += times[t] * _at(s[t], CELL, wide, bend)
            return [*zero(np.concatenate([pull @ z, ((z * curve[:, None]).T @ z).reshape(-1)])), by_stretch(s, CELL, good, bad, z)]

        (_, sums), table = each(slopes)
        d = len(mean)
        (good_cell, good_z), (bad_cell, bad_z) = halves(table)
        cross = good_z.T @ _curvature((bad_cell[None, :] - good_cell[:, None]) * CELL) @ bad_z
        gradient = sums[0, :d] / n_pairs + ridge * now["w"]
        curve = (sums[0, d:].reshape(d, d) - cross - cross.T) / n_pairs + (ridge + 1e-9) * np.eye(d)
        step = np.linalg.solve(curve, gradient)
        model["w"] = now["w"] - step
        if not step.any():
            break

    model = now
    upper = _ranked(each, model, int(n_bad))

    def rest(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple]:
        s = _raw(x, model)[1]
        return zero(np.array([s[s < upper].max(initial=-np.inf)]))

    ((_, below),) = each(rest, np.maximum)
    ((_, sums),) = each(lambda x, good, bad: zero((good + bad) @ np.stack([_raw(x, model)[1] ** k for k in (1, 2)], axis=1)))
    spread_ = np.sqrt(max(sums[0, 1] / n - (sums[0, 0] / n) ** 2, 0.0))
    threshold = (below[0, 0] + upper) / 2 if np.isfinite(below[0, 0]) else upper
    return model | {"threshold": threshold, "spread": max(spread_, 1e-9)}


def learn(x: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> dict | None:
    """The model of labelled features in memory."""
    return fit(lambda f, op=np.add: f(x, (label == 1).astype(np.float64), (label == 0).astype(np.float64)), ridge)


def score(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    raw = _raw(x, model)[1]
    at = np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(3 * (raw - model["threshold"]) / model["spread"] + at, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about `sample` labelled rows outside the held-out fold."""
    taught = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__quality"))
    taught = taught.filter(may_learn(F.col("__id")))
    grain = 1 << 20
    share = min(grain, int(grain * sample / max(taught.count(), 1)) + 1)
    chosen = taught.filter(F.pmod(F.xxhash64("__id"), F.lit(grain)) < share).orderBy(F.xxhash64("__id"), "__quality").limit(2 * sample)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__quality")
    rows = rows.select("doc_id", "text", "__quality", F.xxhash64("doc_id", "text").alias("h"))
    described = rows.mapInArrow(_feature_batches, "doc_id long, __quality int, h long, features array<double>")
    described = described.orderBy("h", "__quality").limit(2 * sample).toPandas()  # doc_ids may be repeated
    described = described.sort_values(["doc_id", "__quality"], kind="stable")
    x = np.array(described["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return x, described["__quality"].to_numpy(np.int64)


def learned_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(features, good, bad) of every labelled row outside the held-out fold, and how often its doc_id is labelled 1 and 0.

    Texts are described where they lie; only features are joined to labels.
    """
    times = lambda q: F.count_if(F.col("quality") == q).cast("double")
    taught = labels.filter(F.col("quality").isin(0, 1) & may_learn(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__id")).agg(times(1).alias("good"), times(0).alias("bad"))
    told = docs.filter(may_learn(F.col("doc_id"))).select("doc_id", "text")
    described = told.mapInArrow(_feature_batches, StructType([docs.schema["doc_id"], StructField("features", ArrayType(DoubleType()))]))
    return described.join(taught, F.col("doc_id") == F.col("__id")).select("features", "good", "bad")


def _over(table: DataFrame) -> Callable:
    """fit's each over a stored table: a task sends its sums by key, never rows."""

    def each(f: Callable, op: np.ufunc = np.add) -> list[tuple]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                found = f(x, *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "bad")])
                held = found if held is None else [_all_sums(list(both), op) for both in zip(held, found, strict=True)]
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["sums"])

        parts = [pickle.loads(r.sums) for r in table.mapInArrow(work, "sums binary").collect()]
        return [_all_sums(list(same), op) for same in zip(*parts, strict=True)] or [(np.zeros(0, np.int64), np.zeros((0, 1)))]

    return each


def score_documents(docs: DataFrame, labels: DataFrame, sample: int | None = None, name: str = "score") -> DataFrame:
    """Returns docs with a column of that name, the score (in place of one that docs has); every row of docs is scored.

    All labelled rows outside the held-out fold teach, unless the caller asks for about `sample` of them.
    """
    docs = spread(docs.drop(name))
    model = learn(*training_rows(docs, labels, sample)) if sample else fit(_over(stored(learned_rows(docs, labels), "quality_features")))
    model = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(np.diff(buffers(batch.column(names.index("text")))[1]), AT_ONCE):
                rows = batch.slice(part.start, part.stop - part.start)
                values = score(features(rows.column(names.index("text"))), model.value)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(values)], [*names, name])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")
