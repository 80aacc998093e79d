"""Vectorised words of Arrow text batches: lower-casing, word limits and 64-bit word hashes in numpy, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UNCHANGED = np.arange(256, dtype=np.uint8)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 19)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _MULTIPLIER, np.uint64)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a text column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of whole rows with at most limit bytes each; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word and the byte behind it, in order.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; rows are limits too.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    limits = offsets[1:-1]
    limits = limits[(limits > 0) & (limits < n)]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[limits] = inside[limits]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[limits - 1] = inside[limits - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of the words at first to last, each byte replaced by fold[byte]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * inverses[first])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words, in order, and n + 1 offsets of each row's words."""
    first, last = word_spans(data, offsets)
    return span_hashes(data, first, last), np.searchsorted(first, offsets).astype(np.int64)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item, given the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
