"""Vectorised hashed n-grams and word hashes over the strings of an Arrow batch."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers of the rolling and the final mixing. They define the buckets.
ROLL, MIX = np.uint32(16777619), np.uint32(2654435761)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of each code point of the basic plane that has one of a single character."""
    table = np.arange(0x10000, dtype=np.uint32)
    for point in range(0x10000):
        if not 0xD800 <= point < 0xE000 and len(low := chr(point).lower()) == 1:
            table[point] = ord(low)
    return table


def lower(points: np.ndarray) -> np.ndarray:
    small = points < 0x10000
    if small.all():
        return lower_table()[points]
    return np.where(small, lower_table()[np.where(small, points, 0)], points)


def owners(offsets: np.ndarray) -> np.ndarray:
    """Row of each element of a concatenation."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def gram_buckets(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each position but the last n - 1 (in uint32)."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = points[:size].astype(np.uint32)
    for k in range(1, n):
        h = h * ROLL + points[k : k + size]
    h ^= h >> np.uint32(15)
    return (h * MIX) >> np.uint32(32 - bits)


def inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-gram at each position ends within its row (for the positions of gram_buckets)."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    size = max(len(ends) - n + 1, 0)
    return np.arange(n, n + size) <= ends[:size]


@lru_cache(maxsize=1)
def _powers(size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(size, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that are no separators, within rows."""
    word = ~separators[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = word[first]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    most = int(length.max())
    powers = _powers(1 << max(12, (most - 1).bit_length()))
    total = int(length.sum())
    before = np.cumsum(length) - length
    within = np.arange(total) - np.repeat(before, length)
    at = within + np.repeat(start, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[within], before)
        return mix64(h + length.astype(np.uint64))


def separator_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: What parts words: the space and the control characters 9 to 13.
SPACES = separator_table(b" \t\n\x0b\x0c\r")
NEWLINE = separator_table(b"\n")
