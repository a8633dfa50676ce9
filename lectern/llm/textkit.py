"""Vectorised text primitives for use inside Spark tasks.

All functions work on one Arrow batch: the UTF-8 bytes of the texts, end to
end, with offsets. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, which bounds memory.
SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = [np.random.default_rng(k).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for k in (11, 12)]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(n + n // 4 + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len(texts) + 1 offsets into them."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about ``limit`` bytes of text: rows, bytes, offsets."""
    texts = texts_of(batch.column(column))
    data, offsets = raw(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True bytes that do not cross a text's end: starts, ends, runs per text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    open_ = inside.copy()
    open_[1:] &= ~inside[:-1] | cut[1:-1]
    close = inside.copy()
    close[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and words per text."""
    return runs(~_WS[data], offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the first or the second one; equal spans have equal hashes."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[which][data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and words per text."""
    data = lower_ascii(data)
    starts, ends, per = words(data, offsets)
    return span_hashes(data, starts, ends), per


def shingle_hashes(hashes: np.ndarray, per: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size``-word window in order, and windows per text.

    A text of fewer words, but not none, has one: all of its words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(per), np.int64)
    factors = mix64(np.arange(1, size + 1, dtype=np.uint64), 77) | np.uint64(1)
    summed = np.zeros(n, np.uint64)
    left = np.repeat(np.cumsum(per), per) - np.arange(n)  # words from here to the text's end
    for k in range(min(size, n)):
        part = hashes[k:] * factors[k]
        summed[: n - k] += np.where(left[: n - k] > k, part, np.uint64(0))
    short = (per > 0) & (per < size)
    first = np.cumsum(per) - per
    keep = left >= size
    keep[first[short]] = True
    summed[first[short]] += per[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix64(summed[keep], 5), np.where(short, 1, np.maximum(per - size + 1, 0))
