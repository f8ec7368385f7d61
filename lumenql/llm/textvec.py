"""Whole batches of texts as one byte array: words, word hashes and rolling hashes without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: White space of the contracts: space and \x09 to \x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_HASH = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers, _inverses = (np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, x, U))]) for x in (_BASE, _INVERSE))
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def parts(array, budget: int = 2_000_000):
    """Runs (first row, rows, bytes, offsets) of a string array, each of at most budget bytes or one text; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not (pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)):
        array = array.cast(pa.large_binary() if pa.types.is_binary(array.type) else pa.large_string())
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_large_binary(array.type) else "")
    n = len(array)
    if not n:
        return
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each text (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums for spans()."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_HASH[data] * powers(len(data))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of bounds, the same for the same bytes anywhere."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def word_hashes(data, start, end) -> np.ndarray:
    return mix(spans(prefix(data), start, end) ^ (end - start).astype(U))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width values; also of runs that cross texts, which the caller leaves out."""
    if len(h) < width:
        return np.zeros(0, U)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(len(h))[0], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(len(h))[1][: len(h) - width + 1] + U(width))


def shingle_sets(data, offsets, width: int):
    """For each text its sorted array of distinct shingle hashes; a text of fewer words has one shingle, of none no shingle."""
    start, end, first = words(data, offsets)
    h = word_hashes(data, start, end)
    grams = window_hashes(h, width)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield window_hashes(h[a:b], int(b - a))
        else:
            yield np.zeros(0, U)
