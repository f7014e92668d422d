"""Texts of an Arrow batch as numpy arrays: bytes, words, shingles and bags, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: An odd multiplier; its powers and their inverses turn prefix sums into hashes of any stretch of bytes.
_P = 0x9E3779B97F4A7C15
_STEP = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (two rounds of shift, exclusive or and multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0], have, step = 1, 1, base
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * _U(step)
        have, step = have + m, step * step & 0xFFFFFFFFFFFFFFFF
    return out


_UP, _DOWN = _powers(_P, _STEP), _powers(pow(_P, -1, 1 << 64), _STEP)
_UP_HIGH, _DOWN_HIGH = int(_UP[-1]) * _P & (2**64 - 1), int(_DOWN[-1]) * pow(_P, -1, 1 << 64) & (2**64 - 1)


def _all_powers(n: int, low: np.ndarray, high: int) -> np.ndarray:
    """The first n powers: a table of the low 16 bits of the exponent times one of the rest."""
    return np.outer(_powers(high, n // _STEP + 1), low).reshape(-1)[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(sizes: np.ndarray, most: int, rows: int = 1 << 15) -> Iterator[slice]:
    """Slices of rows whose sizes sum to at most `most` (a row alone may have more)."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (total + n > most or i - start >= rows):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PLUS_ONE = np.arange(1, 257, dtype=_U)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text): words are runs of 0-9, a-z and bytes from 0x80, A-Z lower-cased."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    low = _FOLD[raw]
    inside = _IS_WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    weighed = _all_powers(n, _UP, _UP_HIGH)
    weighed *= _PLUS_ONE[low]
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum(weighed, out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * _all_powers(n, _DOWN, _DOWN_HIGH)[start])
    return hashes, np.searchsorted(start, offsets, "left")


def shingles(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every k words in a row; a text of 1 to k - 1 words has one shingle, all its words."""
    count = np.diff(before)
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), each)
    first = np.repeat(before[:-1] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(len(doc))
    left = np.minimum(before[1:][doc] - first, k)
    out = np.full(len(doc), 0x51ED270B, _U)
    padded = np.concatenate([hashes, np.zeros(k, _U)])
    for j in range(k):
        out = out * _U(_P) + np.where(left > j, padded[first + j], _U(j + 1))
    return doc, mix(out)


def bags(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number << 48 | 48-bit shingle, how often, shingles of each text), sorted; at most 65,536 texts."""
    raw, offsets = buffers(texts)
    doc, h = shingles(*words(raw, offsets), k)
    keys = np.sort((doc.astype(_U) << _U(48)) | (h >> _U(16)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))), np.bincount(doc, minlength=len(offsets) - 1)
