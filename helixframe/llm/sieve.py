"""A sketch of a set of 64-bit keys, of fixed size, that keeps most other keys from being shuffled.

It never loses a key of the set, and lets through some others, more of them the more keys there are; whoever uses
it joins with the exact set afterwards, or needs no exact set.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sieve(keys: DataFrame, column: str, bits: int = 26):
    """Broadcast bitmap of 2**bits bits (8 MB by default, whatever the number of keys)."""
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = keys.select((F.shiftright(at, 6)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap)).bit_length() - 1 + 6
    at = keys >> np.uint64(64 - bits)
    return ((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
