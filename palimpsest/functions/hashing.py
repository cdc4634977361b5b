"""64-bit hashes and generators that Spark has no built-in for; Arrow UDFs over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1


def fnv1a_u64(x: np.ndarray) -> np.ndarray:
    """FNV-1a of the 8 little-endian bytes of each value."""
    x = x.astype(np.uint64)
    h = np.full(len(x), FNV_OFFSET, np.uint64)
    for i in range(8):
        h = (h ^ ((x >> np.uint64(8 * i)) & np.uint64(255))) * np.uint64(FNV_PRIME)
    return h


def fnv1a_mod(n: int):
    """Column function: FNV-1a of a long, modulo ``n``."""

    @F.pandas_udf("long")
    def go(x: pd.Series) -> pd.Series:
        return pd.Series((fnv1a_u64(x.to_numpy(np.int64)) % np.uint64(n)).astype(np.int64))

    return go


def xorshift(state: int):
    """Endless xorshift64 values (shifts 13, 7, 17); state 0 would stay 0 and becomes 1."""
    x = state & MASK or 1
    while True:
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        yield x


def uniform(*seed):
    """A seeded value in [0, 1) for each row, the same on every run: a hash of seed and columns, not rand()."""
    h = F.xxhash64(*(F.lit(s) if isinstance(s, int) else s for s in seed))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
