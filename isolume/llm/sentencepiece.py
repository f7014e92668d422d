"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is its bytes behind one blank (the pieces' U+2581 is a blank); an empty
text has no tokens. The segmentation with the highest sum of piece scores is
taken; a model whose scores are merge ranks has no probabilities, so its pieces
are scored by rank after Zipf and Mandelbrot. Bytes that no piece covers become byte pieces, whose score is below all
others. Texts are cut where no piece can reach across (before runs of blanks,
around bytes that are in no piece), equal units are done once, and units of
equal length advance together: hashes of their substrings probe the sorted
piece keys and vectorised maxima store the backpointers. Scores are integers, so
sums are exact. A unit longer than LONG is cut into stretches, which advance
together too: each starts WARM bytes early from a frontier of its own. Where the
scores around a cut differ from those of the stretch before by one constant, all
later choices are the same as in one search over the whole unit; otherwise that
stretch is done again from the true frontier. Decoding joins the pieces' bytes;
every text is decoded and compared, so results are lossless.

Defined results: null and empty texts have no tokens and decode to the empty
text; between segmentations of equal score the one whose last piece is shorter
is taken; repeated rows and null doc_ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolume.llm.common import spread
from isolume.llm.textnp import buffers, mix, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
AT_ONCE = 4 << 20
#: Distinct units that a worker remembers between batches (about 40 bytes each).
REMEMBERED = 1_000_000
#: Scores of models whose own are merge ranks: log-probabilities after Zipf and Mandelbrot, -log(SHIFT + rank).
SHIFT = 100
#: Units beyond LONG bytes advance in stretches of STRETCH bytes, each WARM bytes early; WARM is above the longest piece.
LONG, STRETCH, WARM = 384, 256, 128
#: Stretches that advance together.
TOGETHER = 4096
#: Scores are held in so many parts of 1; NEVER is below all sums.
GRAIN, NEVER = 1 << 20, -(1 << 62)
_U = np.uint64
_P = 0x9E3779B97F4A7C15
#: Slots that say whether some piece has such a hash; the top 20 bits of a product.
_SLOTS = 1 << 20


@dataclass
class Vocabulary:
    """Piece bytes in one array, and keys (hashes of their bytes) in sorted order."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    keys: np.ndarray
    key_id: np.ndarray
    key_score: np.ndarray
    lengths: list[int]
    byte_id: np.ndarray
    byte_score: int
    apart: np.ndarray
    seen: np.ndarray


def _hash(matrix: np.ndarray) -> np.ndarray:
    """Hash of each row of bytes: a polynomial in _P, whose high bits are spread."""
    out = np.zeros(len(matrix), _U)
    for column in matrix.T:
        out = out * _U(_P) + column + _U(1)
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * _U(0xD1B54A32D192ED03)) >> _U(44)


def load(path: str = MODEL) -> Vocabulary:
    """Reads a model. Raises if a piece has a blank behind another byte, since units are cut there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, byte_id, found = [], np.full(256, -1), []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            names.append(bytes([int(piece[1:-1], 16)]))
            byte_id[names[-1][0]] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            names.append(b"")
        else:
            names.append(piece.replace("▁", " ").encode())
            found.append((names[-1], i, model.get_score(i)))
    if any(b" " in p.lstrip(b" ") for p, _, _ in found) or (byte_id < 0).any():
        raise ValueError("a model is needed with pieces for all bytes and without blanks inside pieces")
    apart = np.ones(256, bool)
    for p, _, _ in found:
        apart[list(p)] = False
    size = np.array([len(p) for p in names])
    keys = np.concatenate([_hash(np.frombuffer(p, np.uint8)[None, :]) for p, _, _ in found])
    order = np.argsort(keys)
    seen = np.zeros(_SLOTS, bool)
    seen[_slot(keys)] = True
    score = np.array([s for _, _, s in found])
    if score.min() < -100:  # merge ranks; log-probabilities of pieces are well above
        score = -np.log(SHIFT + np.minimum(-score, len(names)))
    score = np.round(score * GRAIN).astype(np.int64)
    if max(size) >= WARM:
        raise ValueError(f"a model is needed whose pieces have less than {WARM} bytes")
    return Vocabulary(
        np.frombuffer(b"".join(names), np.uint8), np.cumsum(size) - size, size, keys[order], np.array([i for _, i, _ in found])[order],
        score[order], sorted({len(p) for p, _, _ in found}), byte_id, int(score.min()) - 10 * GRAIN, apart, seen,
    )


def _advance(words: np.ndarray, v: Vocabulary, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best sums, last piece, its bytes) at every place (places x words) of words of one length (words x bytes).

    before: sums at the first places, known already (places x words); else only the first one, 0.
    """
    n, length = words.shape
    lead = 0 if before is None else len(before) - 1
    best = np.full((length + 1, n), NEVER, np.int64)
    best[: lead + 1] = 0 if before is None else before
    token, back = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.uint8)
    # The hash of a stretch is built leftwards from its end, as _hash does from its start: h(i, j) = h(i+1, j) + (b_i + 1) P^(j-1-i).
    power = np.full(max(v.lengths) + 1, _P, _U)
    power[0] = 1
    power = np.cumprod(power)
    columns = words.T.astype(_U) + _U(1)
    known = set(v.lengths)
    for end in range(lead + 1, length + 1):
        top = best[end - 1] + v.byte_score
        take, step = v.byte_id[words[:, end - 1]].astype(np.int32), np.ones(n, np.uint8)
        h = np.zeros(n, _U)
        for size in range(1, min(end, v.lengths[-1]) + 1):
            h = h + columns[end - size] * power[size - 1]
            if size not in known:
                continue
            some = np.flatnonzero(v.seen[_slot(h)])
            if not len(some):
                continue
            key = h[some]
            at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            hit = v.keys[at] == key
            some, at = some[hit], at[hit]
            total = best[end - size, some] + v.key_score[at]
            better = total > top[some]
            some, at = some[better], at[better]
            top[some], take[some], step[some] = total[better], v.key_id[at], size
        best[end], token[end], back[end] = top, take, step
    return best, token, back


def viterbi(words: np.ndarray, v: Vocabulary, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words (words x bytes) to (ids in one array, tokens of each word); live: their lengths, if they aren't all whole."""
    n, length = words.shape
    _, token, back = _advance(words, v)
    at, row, steps = (np.full(n, length) if live is None else live.copy()), np.arange(n), []
    while len(row):
        steps.append((row, token[at, row]))
        at = at - back[at, row]
        row, at = row[at > 0], at[at > 0]
    count = np.zeros(n, np.int64)
    for rows, _ in steps:
        count[rows] += 1
    ids, ends = np.empty(int(count.sum()), np.int32), np.cumsum(count)
    for k, (rows, found) in enumerate(steps):
        ids[ends[rows] - 1 - k] = found
    return ids, count


def viterbi_long(data: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids of one unit of more than LONG bytes: what viterbi gives, in stretches that advance together."""
    n, reach = len(data), v.lengths[-1]
    token, back = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.uint8)
    width = STRETCH + WARM
    cut = np.arange(0, n, STRETCH)
    start = np.clip(cut - WARM, 0, n - width)
    stop = np.minimum(cut + STRETCH, n)
    front = None  # sums at the last places before a cut, less the last of them
    again: dict[tuple[bytes, bytes], tuple] = {}
    for first in range(0, len(cut), TOGETHER):
        some = slice(first, first + TOGETHER)
        best, tokens, backs = _advance(data[start[some][:, None] + np.arange(width)], v)
        for i, (a, b, c) in enumerate(zip(start[some].tolist(), cut[some].tolist(), stop[some].tolist(), strict=True)):
            own = best[b - a - reach + 1 : b - a + 1, i]
            if b == 0 or np.array_equal(own - own[-1], front):
                token[b + 1 : c + 1], back[b + 1 : c + 1] = tokens[b - a + 1 : c - a + 1, i], backs[b - a + 1 : c - a + 1, i]
                front = best[c - a - reach + 1 : c - a + 1, i]
            else:
                part = data[b - reach + 1 : c]
                key = part.tobytes(), front.tobytes()
                if key not in again:  # texts that repeat themselves come back to the same frontiers
                    sums, ids, sizes = (x[:, 0] for x in _advance(part[None, :], v, front[:, None]))
                    again[key] = sums[len(sums) - reach :].copy(), ids[reach:].copy(), sizes[reach:].copy()
                front, token[b + 1 : c + 1], back[b + 1 : c + 1] = again[key]
            front = front - front[-1]
    ids, at = [], n
    while at:
        ids.append(token[at])
        at -= int(back[at])
    return np.array(ids[::-1], np.int32)


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of consecutive stretches, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Codec:
    """Encodes and decodes batches; remembers units it has done."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.n, self.ids = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _units(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First bytes of the units; starts: those of the texts."""
        cut = np.zeros(len(data), bool)
        blank, apart = data == 32, self.v.apart[data]
        cut[1:] = (blank[1:] & ~blank[:-1]) | apart[1:] | apart[:-1]
        cut[starts] = True
        return np.flatnonzero(cut)

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        """Encodes units, one of each key, in groups of one length."""
        parts, counts = [], np.zeros(len(keys), np.int64)
        order = np.argsort(size, kind="stable")
        # Short units advance with those of their length; longer ones are few, so each takes the width of its group.
        wide = np.where(size <= 32, size, -(-size // 32) * 32)
        ends = np.flatnonzero(np.diff(wide[order])) + 1
        for group in np.split(order, ends):
            if size[group[0]] > LONG:
                for i in group.tolist():
                    parts.append(viterbi_long(data[start[i] : start[i] + size[i]], self.v))
                    counts[i] = len(parts[-1])
                continue
            live, across = size[group], np.arange(wide[group[0]])
            at = np.where(across < live[:, None], start[group][:, None] + across, 0)
            ids, n = viterbi(data[at], self.v, live)
            parts.append(ids)
            counts[group] = n
        begin = np.empty(len(keys), np.int64)
        begin[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        known = np.concatenate([self.known, keys])
        by = np.argsort(known)
        self.known, self.at, self.n = known[by], np.concatenate([self.at, begin])[by], np.concatenate([self.n, counts])[by]
        self.ids = np.concatenate([self.ids, *parts])

    def encode(self, texts: pa.Array, named: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids in one array, tokens of each text). named: equal units, told by a hash, are done once."""
        raw, offsets = buffers(texts)
        size = np.diff(offsets)
        some = size > 0
        if not some.any():
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        starts = (offsets[:-1] + np.cumsum(some) - some)[some]
        data = np.full(len(raw) + int(some.sum()), 32, np.uint8)
        inside = np.ones(len(data), bool)
        inside[starts] = False
        data[inside] = raw
        unit = self._units(data, starts)
        width = np.diff(np.append(unit, len(data)))
        if not named:
            self._forget()
        key = self._keys(data, unit, width) if named else np.arange(len(unit)).astype(_U)
        fresh, first = np.unique(key, return_index=True)
        new = ~np.isin(fresh, self.known, assume_unique=True)
        if len(self.known) + new.sum() > REMEMBERED and len(self.known):
            self._forget()
            new[:] = True
        if new.any():
            self._learn(data, unit[first[new]], width[first[new]], fresh[new])
        at = np.searchsorted(self.known, key)
        ids = self.ids[_stretches(self.at[at], self.n[at])]
        text_of = np.searchsorted(starts, unit, "right") - 1
        count = np.zeros(len(size), np.int64)
        count[some] = np.bincount(text_of, self.n[at], int(some.sum())).astype(np.int64)
        return ids, count

    def _keys(self, data: np.ndarray, unit: np.ndarray, width: np.ndarray) -> np.ndarray:
        """64-bit names of the units: sums of hashed (byte, place in the unit)."""
        place = np.arange(len(data)) - np.repeat(unit, width)
        spread = mix((place.astype(_U) << _U(8)) + data + _U(1))
        return mix(np.add.reduceat(spread, unit) + width.astype(_U))

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets)."""
        v = self.v
        data = v.data[_stretches(v.start[ids], v.size[ids])]
        ends = np.concatenate([[0], np.cumsum(v.size[ids])])
        offsets = ends[np.concatenate([[0], np.cumsum(count)])]
        some = np.diff(offsets) > 0
        inside = np.ones(len(data), bool)
        inside[offsets[:-1][some]] = False  # the blank in front
        return data[inside], offsets - np.concatenate([[0], np.cumsum(some)])

    def encode_exact(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """encode and decode; raises unless the texts come back.

        Two units of one name would spoil a text: then what was remembered is forgotten, and at last no names are used.
        """
        raw, offsets = buffers(texts)
        for named in (True, True, False):
            ids, count = self.encode(texts, named)
            data, at = self.decode(ids, count)
            if np.array_equal(at, offsets) and np.array_equal(data, raw):
                if not named:
                    self._forget()
                return ids, count, data, at
            self._forget()
        raise ValueError("a text did not come back")


def _lists(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Returns doc_id, n_tokens, ids, decoded_sha256 (of the text that the ids decode to) for every row of docs."""
    known = docs.sparkSession.sparkContext.broadcast(load(model))  # as large as the vocabulary

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(known.value)
        for batch in batches:
            for part in pieces(np.diff(buffers(batch.column("text"))[1]), AT_ONCE):
                rows = batch.slice(part.start, part.stop - part.start)
                ids, count, data, at = codec.encode_exact(rows.column("text"))
                whole = data.tobytes()
                digest = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(count), _lists(ids, count), pa.array(digest)], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return spread(rows).mapInArrow(encoded, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def decode_documents(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """Returns doc_id and text for every row of (doc_id, ids); null ids are the empty text."""
    known = tokens.sparkSession.sparkContext.broadcast(load(model))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(known.value)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            data, at = codec.decode(lists.flatten().to_numpy(), lists.value_lengths().to_numpy())
            texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts.cast(pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(decoded, "doc_id long, text string")
