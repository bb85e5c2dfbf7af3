"""Per-key results over data in which a few keys hold most rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"
HOT = "__hot"
KEY = "__key"


@dataclass(frozen=True)
class Part:
    """One aggregate in two stages: `partial` runs per (key, salt), `merge` combines the column of partials."""

    name: str
    partial: Column
    merge: str = "sum"

    def merged(self) -> Column:
        c = F.col(self.name)
        return {"sum": F.sum, "min": F.min, "max": F.max, "any": F.bool_or, "all": F.bool_and}[self.merge](c).alias(self.name)


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys (null too) with at least `share` of all rows: at most 1/share rows, whatever the size of df."""
    counts = df.groupBy(F.col(key).alias(KEY)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)))
    return counts.where(F.col("n") >= F.lit(share) * total.scalar()).select(KEY)


def salted_aggregate(
    df: DataFrame, key: str, parts: list[Part], salt_on: str, salts: int = 32, heavy_share: float = 0.01
) -> DataFrame:
    """Two-stage aggregation by `key`: rows of heavy keys are spread over `salts` groups, partials are merged by key.

    A key is heavy from `heavy_share` of all rows on, found by an exact count of the key column; there are at most
    1/heavy_share such keys, so that list may be broadcast. The salt is a hash of `salt_on`, which
    spreads like a random number but is the same when a lost task runs again; salting on the column of an exact distinct
    count keeps that count additive, as each value meets one salt only.

    Null keys form a group of their own. An empty input gives an empty result. Columns of df beyond those used don't
    matter, whatever their names; repeated rows count as often as they occur.
    """
    if not 0 < heavy_share <= 1 or salts < 1:
        raise ValueError("heavy_share must be in (0, 1] and salts at least 1")
    hot = F.broadcast(heavy_keys(df, key, heavy_share).withColumn(HOT, F.lit(True)))
    salted = df.withColumn(KEY, F.col(key)).alias("d").join(hot.alias("h"), F.col(f"d.{KEY}").eqNullSafe(F.col(f"h.{KEY}")), "left")
    salt = F.when(F.col(HOT), F.pmod(F.xxhash64(F.col(f"d.{salt_on}")), F.lit(salts))).otherwise(F.lit(0))
    partial = salted.groupBy(F.col(f"d.{KEY}").alias(KEY), salt.alias(SALT)).agg(*[p.partial.alias(p.name) for p in parts])
    return partial.groupBy(F.col(KEY).alias(key)).agg(*[p.merged() for p in parts])


def keys_with_share(counts: DataFrame, key: str, n: str, per_mille: int) -> DataFrame:
    """Non-null keys holding at least per_mille/1000 of the rows counted in `counts` (null key included in all)."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col(n) * 1000 >= total * per_mille)).select(key)
