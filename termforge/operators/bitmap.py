"""A bitmap of fixed size of the strings that a table holds, for dropping at the source what can't join."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
SHIFTS = (0, 26)


def string_bitmap(df: DataFrame, column: str) -> bytes:
    """Two bits for every non-null string, of the same hash as string_hash(); 8 MiB whatever the table's size."""
    h = F.xxhash64(column)
    at = F.array(*[F.shiftright(h, s).bitwiseAND(BITS - 1) + 1 for s in SHIFTS])
    places = df.where(F.col(column).isNotNull()).select(F.explode(at).alias("at"))
    maps = places.groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in maps.collect():
        out[(r.n - 1) * 4096 : r.n * 4096] = np.frombuffer(bytes(r.map), np.uint8)
    return out.tobytes()


def string_hash(s: str) -> int:
    """The engine's own 64-bit hash of a string, with its seed."""
    return xxhash.xxh64_intdigest(s.encode(), 42)


def may_hold(bitmap: bytes, s: str) -> bool:
    h = string_hash(s)
    for shift in SHIFTS:
        at = (h >> shift) & (BITS - 1)
        if not bitmap[at >> 3] >> (at & 7) & 1:
            return False
    return True
