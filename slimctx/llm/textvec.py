"""Words and word hashes of a batch of UTF-8 texts, as numpy arrays.

All hashes are polynomials modulo 2**64 over random byte or word values,
finished by a mixer; they depend on the hashed bytes alone."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
BASE, GRAM = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE9846AF9B1A615D)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


def byte_values(fold: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte, equal for bytes folded together."""
    return mix((fold.astype(np.uint64) + np.uint64(1)) * _ODD)


def lower_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1); kept for the next block of the task."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(n, 1).bit_length(), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def segment_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray,
                   base: int = BASE) -> np.ndarray:
    """The hash of values[start:stop] for every pair of bounds."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    back = powers(inverse(base), len(values) + 1)
    return mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, stop, doc) of every run of bytes that are not ``blank``; texts
    are data[off[i]:off[i + 1]]."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(off, start, "right") - 1


def blocks(off: np.ndarray, limit: int):
    """Ranges (i, j) of texts of about ``limit`` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j
