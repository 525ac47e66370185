"""A broadcast bitmap of fixed size that says which hashes may matter.

Setting a bit for every wanted hash lets a second pass over the data leave out
rows early. Other hashes may share a bit, so the bitmap only saves work: what
comes through must be settled by the join or count that follows.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27  # 16 MB, whatever the data


def bits_for(n: int) -> int:
    """A size, :data:`BITS` at most, that gives each of ``n`` hashes 64 bits or more, so that small tables need little of the driver."""
    return min(BITS, max(1 << 15, 1 << (64 * n).bit_length()))


def broadcast_bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """Broadcast a bitmap of ``bits`` bits (a power of two) with those of the hashes set."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1  # Spark's bitmap buckets begin at place 1
    parts = (
        hashes.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    )
    whole = np.zeros(max(bits // 8, 4096), dtype=np.uint8)
    for row in parts.toLocalIterator():  # bits / 32768 parts of 4 kB at most
        at = (row["bucket"] - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(row["bitmap"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole)


def in_bitmap(hashes: np.ndarray, bitmap: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether the bit of each (unsigned) hash is set."""
    place = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
