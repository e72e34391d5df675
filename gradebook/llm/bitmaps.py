"""Fixed-size bitmaps of hashes: they keep rows without a counterpart out of a shuffle.

A bitmap has the same 2 MB at every size. The fuller it is the more it lets
through; it never keeps out a row that has a counterpart, and the join that follows is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of the column ``hash``, from at most ``BITS / 64`` aggregated rows, which come as two Arrow columns."""
    slot = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    rows = (
        hashes.groupBy(F.shiftright(slot, 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).toArrow())
    bits = np.zeros(BITS // 64, np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each unsigned hash may have a counterpart."""
    slot = hashes & np.uint64(BITS - 1)
    return ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
