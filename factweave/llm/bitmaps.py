"""Bitmaps of hashes: one bit for each remainder, of a fixed size, so that tasks can pass over rows without a shuffle.

A set bit may stand for another hash: what passes is joined afterwards, so a wrong bit only adds work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits of column `hash` modulo a power of two, as bytes."""
    place = F.pmod("hash", F.lit(bits)) + 1  # the functions count from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each signed 64-bit hash is set."""
    place = np.mod(hashes, 8 * len(bitmap))
    return ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
