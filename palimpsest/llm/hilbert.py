"""Hilbert index of points in several dimensions, after Skilling (2004)."""

from __future__ import annotations

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of ``points`` (rows; unsigned, ``bits`` bits in each of d dimensions; d * bits <= 63)."""
    x = np.array(points, np.uint64).T.copy()
    d, n = x.shape
    if d * bits > 63:
        raise ValueError("d * bits must be at most 63")
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo excess work, from the highest bit
        q = one << np.uint64(b)
        low = q - one
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[d - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    out = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)
