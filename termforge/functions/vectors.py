"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a||b|); null for an all-zero vector or vectors of different size."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.lit(1.0) - dot(a, b) / n)


def usable(v: Column, dim: int | None = None) -> Column:
    ok = v.isNotNull() & F.exists(v, lambda x: x != 0)
    return ok if dim is None else ok & (F.size(v) == dim)


def mean_vector(df: DataFrame, keys: list[str], vec: str, out: str = "centroid") -> DataFrame:
    """Element-wise mean of a vector column per key, in one pass: each element is averaged with map-side combining."""
    parts = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    if keys:
        return means.groupBy(*keys).agg(_ordered().alias(out))
    return means.agg(_ordered().alias(out))


def _ordered() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])


def mean_vector_fixed(df: DataFrame, keys: list[str], vec: str, dim: int, out: str = "centroid") -> DataFrame:
    """mean_vector() for a known number of elements: one aggregation row per key instead of one per element."""
    aggs = [F.avg(F.col(vec)[i].cast("double")).alias(f"m{i}") for i in range(dim)]
    means = df.groupBy(*keys).agg(*aggs)
    return means.select(*keys, F.array(*[f"m{i}" for i in range(dim)]).alias(out))
