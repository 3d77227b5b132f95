"""A set of 64-bit hashes as a bitmap, for dropping rows before a shuffle.

It may let other hashes through, never loses one, and what it lets through is
always joined or counted exactly afterwards. Its size follows the number of
hashes, PLACES_PER_BIT at most a bit, up to MOST_BITS, the bound of what is
broadcast; a bitmap at the bound lets more through the more hashes it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 28  # 8 KB, 32 MB
PLACES_PER_BIT = 1 / 8  # bits that are set, at most: one hash in 64 is let through by chance


def _places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def contains(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set."""
    a, b = _places(hashes, np.uint64(8 * len(bitmap) - 1))
    return ((bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _folded(packed: np.ndarray, least_bits: int) -> np.ndarray:
    """The smallest bitmap of the same hashes that is sparse enough: places in the upper half
    are those in the lower half once a place has one bit less."""
    while len(packed) > 1 << (least_bits - 6):
        lower, upper = packed[:len(packed) // 2], packed[len(packed) // 2:]
        half = lower | upper
        if int(np.bitwise_count(half).sum()) > PLACES_PER_BIT * 64 * len(half):
            break
        packed = half
    return packed


def hash_filter(df: DataFrame, column: str, most_bits: int = MOST_BITS) -> Broadcast:
    """The bitmap of a long column, gathered by bitwise or and broadcast; nulls are not in it."""
    mask = np.uint64((1 << most_bits) - 1)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(np.concatenate(_places(hashes, mask)))
            at, first = np.unique(place >> 6, return_index=True)
            found = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found.view(np.int64))], ["at", "bits"])

    found = df.select(column).mapInArrow(bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(1 << (most_bits - 6), np.uint64)
    packed[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(_folded(packed, min(LEAST_BITS, most_bits)).view(np.uint8).copy())
