"""Which of many 64-bit keys may be in a table: a bitmap of bounded size that tasks carry along.

A key that is in the table is never missed.  Of other keys a share passes, which grows as the
bitmap fills; so what passes must be told apart by a later step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many bits, which are 32 MB.
BITS = 1 << 28
#: Bits for each key, up to that.
SHARE = 16
#: Bits that one row of the aggregation holds, by Spark's functions.
PAGE = 1 << 15


class Bitmap:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each 64-bit key may be in the table; keys must be evenly spread hashes."""
        at = keys.view(np.int64) & (8 * len(self.bits) - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(keys: DataFrame, column: str) -> Bitmap:
    """The bitmap of a saved table's keys."""
    wanted, bits = SHARE * keys.count(), PAGE
    while bits < min(BITS, wanted):
        bits *= 2
    at = F.col(column).bitwiseAND(bits - 1)
    pages = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("at") % PAGE).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for page, b in pages.toLocalIterator():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(b, np.uint8)
    return Bitmap(out)
