"""A bitmap of bounded size over hashes: what is not in it is certainly not in the set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one part as Spark's bitmap aggregate builds it.
PART = 32768


def width(n: int, spare: int = 1024, most: int = 1 << 28) -> int:
    """Bits for n hashes: ``spare`` a hash, a power of two, never more than ``most`` (32 MB)."""
    return min(most, max(PART, 1 << max(0, n * spare - 1).bit_length()))


def build(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bitmap's bytes; at most ``bits`` / 8 of them reach the driver, whatever the data."""
    slots = hashes.select(F.pmod(F.col(column), F.lit(bits)).alias("slot")).select((F.col("slot") / PART).cast("long").alias("part"), F.pmod("slot", F.lit(PART)).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for r in slots.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each signed 64-bit hash may be in the set."""
    slot = np.mod(hashes, len(bitmap) * 8)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
