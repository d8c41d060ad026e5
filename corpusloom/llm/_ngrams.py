"""Character n-grams of texts as numpy arrays."""

from __future__ import annotations

from functools import cache

import numpy as np


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str | bytes | None) -> np.ndarray:
    """Lower-cased code points with a space at both ends; all but letters are spaces."""
    s = (text.decode() if isinstance(text, bytes) else text or "").lower()
    a = np.frombuffer(f" {s} ".encode("utf-32-le"), np.uint32)
    return np.where(_letters()[a], a, np.uint32(32))


def _whole(a: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n code points are n-grams: those with spaces at their ends only, and not at both of two."""
    space = a == 32
    if n == 1:
        return ~space
    size = len(a) - n + 1
    if n == 2:
        return ~(space[:size] & space[1:])
    ok = ~space[1 : 1 + size]
    for k in range(2, n - 1):
        ok &= ~space[k : k + size]
    return ok


def packed(a: np.ndarray, n: int) -> np.ndarray:
    """The n-grams (n up to 3), repeats included, as integers that name them."""
    size = len(a) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = a[:size].astype(np.uint64)
    for k in range(1, n):
        out = out << np.uint64(21) | a[k : k + size]
    return out[_whole(a, n)]


def hashed(a: np.ndarray, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """The distinct n-grams of the given sizes (3 or more), hashed to ``buckets`` (a power of two), sorted."""
    found = []
    for n in sizes:
        size = len(a) - n + 1
        if size > 0:
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h = (h ^ a[k : k + size]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            found.append((h & np.uint32(buckets - 1))[_whole(a, n)])
    if not found:
        return np.zeros(0, np.uint32)
    h = np.sort(np.concatenate(found))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
