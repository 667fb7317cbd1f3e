"""Words and word hashes of a batch of texts, vectorised over UTF-8 bytes.

A word is a run of bytes outside x20, x09-x0D; A-Z are lower-cased before
hashing. Hashes are 64 bits; the same word has the same hash everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21  # text held in numpy temporaries at a time (a longer text is a slice of its own)

_U = np.uint64
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LONG = 1 << 16
with np.errstate(over="ignore"):
    _POW = np.multiply.accumulate(np.full(_LONG, 0x9E3779B97F4A7C15, np.uint64))
_SHINGLE = _rng.integers(1, 1 << 63, 6, dtype=np.uint64) * _U(2) + _U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def as_texts(column) -> pa.Array:
    """An Arrow text column as one large_string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each in them."""
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of at most ``limit`` bytes, whole texts only."""
    _, offs = raw(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


def segments(keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes, cut at text boundaries."""
    n = len(keep)
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    edge = offs[(offs > 0) & (offs < n)]
    first[edge] = keep[edge]
    last[edge - 1] = keep[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(values: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each segment from the byte values kept in it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values)))) if starts[0] == 0 \
        else np.arange(len(values)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(values)]))))
    each = _BYTE[values] * _POW[place & (_LONG - 1)]
    if len(values) > _LONG:
        each *= (place >> 16).astype(np.uint64) * _U(2) + _U(1)
    each[~keep] = 0
    return mix(np.add.reduceat(each, starts))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every word, in order."""
    data, offs = raw(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keep = ~SPACE[data]
    starts, _ = segments(keep, offs)
    return np.searchsorted(offs, starts, side="right") - 1, hashes(LOWER[data], keep, starts)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``size``-word shingles of each text as 64-bit hashes;
    a text with fewer words has its whole sequence as one, an empty one none."""
    doc, word = word_hashes(texts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = len(word)
    if n >= size:
        acc = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            acc += word[k:n - size + 1 + k] * _SHINGLE[k]
        acc = mix(acc)
    out = []
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s >= size:
            out.append(np.unique(acc[s:e - size + 1]))
        elif e > s:
            out.append(mix((word[s:e] * _SHINGLE[:e - s]).sum(keepdims=True) + _SHINGLE[5:] * _U(e - s)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
