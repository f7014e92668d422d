"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes, one from either end; a softmax
on both states labels every position, and the probabilities of all positions
are averaged over the document. Texts are cut into segments of SEGMENT bytes,
each of which starts from the zero state, so that many segments advance
together; every byte of every text is read.

The network is trained in numpy by backpropagation through time on windows of
at most about SAMPLE documents (chosen by a hash of doc_id and text, and never more than
twice as many, the first by that hash) outside the held-out fold.

Defined results: a null text, and one without a letter, is `und` with score 0;
without rows to learn from every text is; ties go to the language that sorts
first; rows that repeat a doc_id are labelled apart. Columns other than doc_id,
text and lang (to learn from) pass through, but those named as a result's column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolume.llm.common import may_learn, spread, unused
from isolume.llm.textnp import buffers, pieces

HIDDEN, SEGMENT, WINDOW = 8, 128, 64
#: Documents that windows are taken from, windows of each, steps and windows of a step.
SAMPLE, WINDOWS, STEPS, BATCH = 4096, 2, 300, 192
#: Segments that advance together, and bytes of text that are held as segments at once.
TOGETHER, AT_ONCE = 2048, 2 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(x: np.ndarray, table: np.ndarray, u: np.ndarray) -> list[tuple]:
    """States of one direction with what backpropagation needs; x: steps x windows."""
    n = table.shape[1] // 3
    h, kept = np.zeros((x.shape[1], n), np.float32), []
    for byte in x:
        a, b = table[byte], h @ u
        z, r = _sigmoid(a[:, :n] + b[:, :n]), _sigmoid(a[:, n : 2 * n] + b[:, n : 2 * n])
        c = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
        new = z * h + (1 - z) * c
        kept.append((h, z, r, c, b[:, 2 * n :], new))
        h = new
    return kept


def _back(x: np.ndarray, kept: list[tuple], u: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of u, through time from the last step to the first."""
    d_table, d_u, d_h = np.zeros((256, u.shape[1]), np.float32), np.zeros_like(u), 0.0
    for t in range(len(x) - 1, -1, -1):
        before, z, r, c, b, _ = kept[t]
        d = d_out[t] + d_h
        d_c = d * (1 - z) * (1 - c * c)
        d_z, d_r = d * (before - c) * z * (1 - z), d_c * b * r * (1 - r)
        d_b = np.concatenate([d_z, d_r, d_c * r], axis=1)
        d_u += before.T @ d_b
        d_h = d * z + d_b @ u.T
        np.add.at(d_table, x[t], np.concatenate([d_z, d_r, d_c], axis=1))
    return d_table, d_u


def train(windows: np.ndarray, label: np.ndarray, classes: int, steps: int = STEPS, batch: int = BATCH, seed: int = 3) -> dict[str, np.ndarray]:
    """windows: rows of WINDOW bytes. Adam on the mean cross entropy of all positions."""
    draw = np.random.default_rng(seed)
    shapes = {"table_f": (256, 3 * HIDDEN), "u_f": (HIDDEN, 3 * HIDDEN), "table_b": (256, 3 * HIDDEN), "u_b": (HIDDEN, 3 * HIDDEN), "head": (2 * HIDDEN, classes), "bias": (classes,)}
    p = {k: (draw.standard_normal(s) * (0.0 if k == "bias" else 0.3)).astype(np.float32) for k, s in shapes.items()}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        rows = draw.integers(0, len(windows), batch)
        x, y = windows[rows].T, label[rows]
        forth, back = _run(x, p["table_f"], p["u_f"]), _run(x[::-1], p["table_b"], p["u_b"])[::-1]
        state = np.stack([np.concatenate([a[-1], b[-1]], axis=1) for a, b in zip(forth, back, strict=True)])
        logit = state @ p["head"] + p["bias"]
        e = np.exp(logit - logit.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(batch), y] -= 1
        d /= d.shape[0] * batch
        d_state = d @ p["head"].T
        g = {"head": np.tensordot(state, d, ([0, 1], [0, 1])), "bias": d.sum(axis=(0, 1))}
        g["table_f"], g["u_f"] = _back(x, forth, p["u_f"], d_state[:, :, :HIDDEN])
        g["table_b"], g["u_b"] = _back(x[::-1], back[::-1], p["u_b"], d_state[::-1, :, HIDDEN:])
        rate = 0.03 * (1 - step / (steps + 1))
        for k, v in g.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


class _Cell:
    """One direction's step for many segments, features first; half the gates' inputs makes sigmoids of tangents."""

    def __init__(self, table: np.ndarray, u: np.ndarray, n: int):
        half = np.ones(3 * HIDDEN, np.float32)
        half[: 2 * HIDDEN] = 0.5
        self.table, self.u = np.ascontiguousarray((table * half).T), np.ascontiguousarray((u * half).T)
        self.a, self.b, self.h = np.empty((3 * HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)

    def step(self, byte: np.ndarray) -> np.ndarray:
        a, b, h, n = self.a, self.b, self.h, HIDDEN
        np.take(self.table, byte, axis=1, out=a, mode="clip")
        np.matmul(self.u, h, out=b)
        gates = a[: 2 * n]
        gates += b[: 2 * n]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        c = a[2 * n :]
        b[2 * n :] *= a[n : 2 * n]
        c += b[2 * n :]
        np.tanh(c, out=c)
        h -= c
        h *= a[:n]
        h += c
        return h


def label_positions(x: np.ndarray, live: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Sums of the class probabilities of all positions of each segment; x: segments x bytes, live: their lengths."""
    n, steps = x.shape
    across = np.ascontiguousarray(x.T).astype(np.intp)
    forth, back = _Cell(p["table_f"], p["u_f"], n), _Cell(p["table_b"], p["u_b"], n)
    head_f, head_b, bias = np.ascontiguousarray(p["head"][:HIDDEN].T), np.ascontiguousarray(p["head"][HIDDEN:].T), p["bias"][:, None]
    logits = np.empty((steps, len(bias), n), np.float32)
    for t in range(steps):
        np.matmul(head_f, forth.step(across[t]), out=logits[t])
    total = np.zeros((len(bias), n), np.float32)
    full = int(live.min(initial=steps))
    for t in range(steps - 1, -1, -1):
        h = back.step(across[t])
        if t >= full:
            on = t < live
            h *= on  # the padding leaves the zero state that a segment starts from
        q = logits[t]
        q += head_b @ h
        q += bias
        np.exp(q, out=q)
        q /= q.sum(axis=0)
        if t >= full:
            q *= on
        total += q
    return total.T


def document_probabilities(texts: pa.Array, p: dict[str, np.ndarray]) -> np.ndarray:
    """(texts x classes): the mean over all bytes; zeros for an empty text."""
    raw, offsets = buffers(texts)
    size = np.diff(offsets)
    each = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), each)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * SEGMENT
    live = np.minimum(offsets[1:][doc] - start, SEGMENT)
    out = np.zeros((len(size), len(p["bias"])))
    padded = np.concatenate([raw, np.zeros(SEGMENT, np.uint8)])
    order = np.argsort(-live, kind="stable")
    for i in range(0, len(doc), TOGETHER):
        some = order[i : i + TOGETHER]
        longest = int(live[some[0]])
        x = padded[start[some][:, None] + np.arange(longest)]
        np.add.at(out, doc[some], label_positions(x, live[some], p))
    return out / np.maximum(size, 1)[:, None]


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, list[str]]:
    """Windows of WINDOW bytes and their languages, of at most about `sample` documents."""
    rows = docs.filter(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    grain = 1 << 20
    share = min(grain, int(grain * sample / max(rows.count(), 1)) + 1)
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).filter(F.pmod("h", F.lit(grain)) < share)
    starts = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length("text")).cast("int") for i in range(WINDOWS)]
    taken = rows.select("doc_id", "lang", "h", *[F.substring("text", s + 1, F.lit(WINDOW)).alias(f"w{i}") for i, s in enumerate(starts)])
    got = taken.orderBy("h", "lang").limit(2 * sample).toPandas().sort_values(["doc_id", "w0"], kind="stable")
    texts, langs = [], []
    for i in range(WINDOWS):
        texts += [t.encode()[:WINDOW].ljust(WINDOW) for t in got[f"w{i}"]]
        langs += got["lang"].tolist()
    return np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WINDOW), langs


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Returns docs' columns but text and lang, with lang_pred and score.

    learn_from: documents with languages (docs unless given).
    """
    spark = docs.sparkSession
    windows, langs = training_windows(docs if learn_from is None else learn_from)
    classes = sorted(set(langs))
    model = train(windows, np.array([classes.index(x) for x in langs]), len(classes)) if classes else None
    known = spark.sparkContext.broadcast((model, classes))
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("text", "lang", "lang_pred", "score")]
    names = [f.name for f in kept]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, langs = known.value
        for batch in batches:
            for part in pieces(np.diff(buffers(batch.column(len(names)))[1]), AT_ONCE):
                rows = batch.slice(part.start, part.stop - part.start)
                letters = rows.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
                if p is None:
                    best, share = [None] * rows.num_rows, np.zeros(rows.num_rows)
                else:
                    q = document_probabilities(rows.column(len(names)), p)
                    best, share = [langs[i] for i in q.argmax(axis=1)], np.clip(q.max(axis=1), 0, 1)
                pred = ["und" if not ok or x is None else x for ok, x in zip(letters.tolist(), best, strict=True)]
                arrays = [*[rows.column(c) for c in names], pa.array(pred, pa.string()), pa.array(np.where(letters, share, 0.0))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "lang_pred", "score"])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lang_pred string", "score double"])
    has_letter = F.coalesce(F.regexp_like("text", F.lit("\\p{L}")), F.lit(False))
    letters = unused("__letters", names)
    return spread(docs.select(*names, "text", has_letter.alias(letters))).mapInArrow(labelled, ddl)
