"""A filter of fixed size for 64-bit hashes: it lets every hash of a table through, and few others.

The filter is a bitmap whose size is a parameter and does not follow the data,
so it can be sent to every task. A crowded filter lets more strangers
through, never fewer members; whoever uses it compares exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def hash_filter(hashes: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """A broadcast array of ``bits / 64`` words with one bit set for each hash; nulls are left out."""
    place = F.pmod(F.col(column), F.lit(bits))
    marks = hashes.where(F.col(column).isNotNull()).select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("mark"))
    words = marks.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()  # at most bits / 64 rows
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("mark").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for each signed 64-bit hash that is in the table, and for a few that are not."""
    place = hashes & (len(bitmap) * 64 - 1)
    return (bitmap[place >> 6] >> (place & 63)) & 1 == 1

