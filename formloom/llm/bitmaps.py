"""Bitmaps of hashed keys: a filter of bounded size that goes to all tasks and lets through every key that was put in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: at least, and at most (8 MB). Beyond that more keys pass that were not put in; callers join anyway.
LEAST, MOST = 16, 26


def bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """The bitmap of `keys` (one column of longs), sized for `count` of them.

    The bits are put together in the tasks: at most 2**MOST / 64 numbers meet in the driver, however many keys there are.
    """
    bits = min(MOST, max(LEAST, (8 * count).bit_length()))
    spot = F.pmod(F.col(keys.columns[0]), F.lit(1 << bits))
    parts = keys.select(F.shiftright(spot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int")).alias("bit"))
    found = parts.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["at"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (signed longs) may have been put in; those put in always are."""
    spot = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
