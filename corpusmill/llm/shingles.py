"""Sets of hashed word shingles, made in tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

WIDTH = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of five-word shingles, ascending; fewer words count as one shingle, no words as none.

    Words are runs of bytes other than blank and U+0009..U+000D, with A-Z lower-cased: what ``bytes`` methods do.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    if n < WIDTH:
        return mix((h * _ODD[:n]).sum(keepdims=True) + np.uint64(n))
    g = h[: n - WIDTH + 1] * _ODD[0]
    for j in range(1, WIDTH):
        g = g + h[j : n - WIDTH + 1 + j] * _ODD[j]
    return np.unique(mix(g))
