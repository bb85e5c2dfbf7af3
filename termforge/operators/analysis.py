"""Analytics of a dictionary's vectors: centroids, distances, outliers, leave-one-out validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions.vectors import cosine_distance, mean_vector_fixed, usable
from termforge.operators.knn import exact_knn


def searchable_vectors(semantic: DataFrame, dim: int) -> DataFrame:
    """(id, label, identifier, embedding) of searchable entries with a usable vector."""
    return semantic.where(F.col("searchable") & usable(F.col("embedding"), dim)).select("id", "label", "identifier", "embedding")


def centroid_all(vectors: DataFrame, dim: int) -> DataFrame:
    return mean_vector_fixed(vectors.withColumn("one", F.lit(1)), ["one"], "embedding", dim).drop("one")


def centroid_by_cluster(vectors: DataFrame, least: int, dim: int) -> DataFrame:
    """Mean vector per identifier with at least `least` entries."""
    sizes = vectors.where("identifier IS NOT NULL").groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))
    means = mean_vector_fixed(vectors.where("identifier IS NOT NULL"), ["identifier"], "embedding", dim)
    return means.join(sizes.where(F.col("n") >= least), "identifier")


def _avg_max(d: DataFrame) -> DataFrame:
    return d.agg(F.round(F.avg("distance"), 4).alias("avg_distance"), F.round(F.max("distance"), 4).alias("max_distance"))


def centroid_stats(vectors: DataFrame, dim: int) -> DataFrame:
    """Mean and largest distance to the common centroid. The centroid is one row, so joining it to every entry copies `dim` numbers a task."""
    one = F.broadcast(centroid_all(vectors, dim))
    return _avg_max(vectors.crossJoin(one).select(cosine_distance(F.col("embedding"), F.col("centroid")).alias("distance")))


def cluster_distances(vectors: DataFrame, least: int, dim: int) -> DataFrame:
    """(id, identifier, n, distance to the centroid of its cluster)."""
    own = centroid_by_cluster(vectors, least, dim)
    return vectors.join(own, "identifier").select(
        "id", "label", "identifier", "n", cosine_distance(F.col("embedding"), F.col("centroid")).alias("distance")
    )


def local_stats(vectors: DataFrame, least: int, dim: int) -> DataFrame:
    return _avg_max(cluster_distances(vectors, least, dim))


def local_outliers(vectors: DataFrame, least: int, z_most: float, dim: int) -> DataFrame:
    """Entries whose distance to their cluster's centroid lies more than z_most deviations above the cluster's mean."""
    d = cluster_distances(vectors, least, dim)
    spread = d.groupBy("identifier").agg(F.avg("distance").alias("mean"), F.stddev("distance").alias("deviation"))
    z = (F.col("distance") - F.col("mean")) / F.nullif(F.col("deviation"), F.lit(0.0))
    return d.join(spread, "identifier").withColumn("z_score", z).where(F.col("z_score") > z_most).orderBy(F.desc("z_score"), "id")


def origin_distances(vectors: DataFrame, origins: DataFrame) -> DataFrame:
    """(id, label, identifier, distance, closest): distance to the nearest origin, and its name.

    origins: (no, term, vec) of the few origin terms of an analysis; collected, as their number is given by the caller.
    """
    terms = origins.orderBy("no").collect()
    if not terms:
        return vectors.select("id", "label", "identifier").withColumn("distance", F.lit(None).cast("double")).withColumn("closest", F.lit(None).cast("string"))
    each: list[Column] = [cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in t.vec])) for t in terms]
    named = vectors.select("id", "label", "identifier", *[d.alias(f"d{i}") for i, d in enumerate(each)])
    least = F.least(*[f"d{i}" for i in range(len(terms))]) if len(terms) > 1 else F.col("d0")
    closest = F.coalesce(*[F.when(F.col(f"d{i}") == F.col("distance"), F.lit(t.term)) for i, t in enumerate(terms)])
    return named.withColumn("distance", least).withColumn("closest", closest).drop(*[f"d{i}" for i in range(len(terms))])


def origin_stats(vectors: DataFrame, origins: DataFrame) -> DataFrame:
    return _avg_max(origin_distances(vectors, origins))


def origin_outliers(vectors: DataFrame, origins: DataFrame, below: float = 0.75, limit: int | None = None) -> DataFrame:
    found = origin_distances(vectors, origins).where(F.col("distance") < below).orderBy("distance", "id")
    return found if limit is None else found.limit(limit)


def outlier_distribution(outliers: DataFrame) -> DataFrame:
    return outliers.groupBy("closest").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Cleaned:
    outliers: DataFrame  # (id, stage)
    report: DataFrame
    semantic: DataFrame  # with the flags after cleaning, or as given in a dry run


def with_flags(semantic: DataFrame, outliers: DataFrame, dry_run: bool) -> DataFrame:
    if dry_run:
        return semantic
    gone = outliers.select("id").distinct().withColumn("__out", F.lit(True))
    return semantic.join(gone, "id", "left").withColumn("searchable", F.col("searchable") & F.col("__out").isNull()).drop("__out")


def clean_two_stage(
    semantic: DataFrame, origins: DataFrame, dim: int, below: float = 0.75, z_most: float = 2.0, least: int = 3, dry_run: bool = True
) -> Cleaned:
    """Outliers near the origin terms, then outliers within clusters among the rest; marked unsearchable unless dry_run.

    No outliers: a report of zeros.
    """
    vectors = searchable_vectors(semantic, dim)
    first = origin_outliers(vectors, origins, below).select("id", F.lit("global").alias("stage"))
    second = local_outliers(vectors.join(first, "id", "left_anti"), least, z_most, dim).select("id", F.lit("local").alias("stage"))
    both = first.unionByName(second)
    report = both.agg(
        F.count_if(F.col("stage") == "global").alias("global_outliers"),
        F.count_if(F.col("stage") == "local").alias("local_outliers"),
        F.count_distinct("id").alias("total_outliers"),
    )
    return Cleaned(both, report, with_flags(semantic, both, dry_run))


def clean_by_origin(semantic: DataFrame, origins: DataFrame, dim: int, below: float = 0.75, dry_run: bool = True, tested: Column | None = None) -> Cleaned:
    """Outliers near the origin terms; marked unsearchable unless dry_run.

    The report has how many there are and were searchable, and for the vectors before and after the distances to the common centroid and
    the metrics of leave_one_out() for the rows that `tested` names, by default a seeded sample of 1,000. In a dry run `after` is what would be.
    """
    vectors = searchable_vectors(semantic, dim)
    outliers = origin_outliers(vectors, origins, below).select("id", F.lit("global").alias("stage"), "distance", "closest")
    after = with_flags(semantic, outliers, False)

    def state(rows: DataFrame, when: str) -> DataFrame:
        asked = sample(rows, 1000) if tested is None else rows.where(tested)
        metrics = leave_one_out(rows, asked)[1]
        both = centroid_stats(rows, dim).crossJoin(metrics)  # single rows
        return both.select(*[F.col(c).alias(f"{c}_{when}") for c in both.columns])

    n = outliers.agg(F.count(F.lit(1)).alias("n_outliers"))
    report = n.crossJoin(state(vectors, "before")).crossJoin(state(searchable_vectors(after, dim), "after"))  # three single rows
    return Cleaned(outliers, report, semantic if dry_run else after)


def similar_entries(vectors: DataFrame, asked: DataFrame, limit: int = 10, exclude_same_identifier: bool = False) -> DataFrame:
    """(query, id, similarity, distance, rank): nearest searchable entries to the asked ones, never themselves; rounded to 4 digits."""
    grp = F.col("identifier") if exclude_same_identifier else F.lit(None).cast("string")
    q = asked.select(F.col("id").alias("no"), grp.alias("grp"), F.col("embedding").alias("vec"))
    r = vectors.select("id", grp.alias("grp"), F.col("embedding").alias("vec"))
    found = exact_knn(q, r, limit)
    return found.select("query", "id", F.round(1 - F.col("distance"), 4).alias("similarity"), F.round("distance", 4).alias("distance"), "rank")


def sample(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows in the order of a seeded hash of the id: the same each time."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def leave_one_out(vectors: DataFrame, asked: DataFrame, least: int = 2, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per tested entry the rank of its first neighbour with the same identifier among k others, and the metrics over all.

    Tested are the asked entries whose identifier has at least `least` searchable entries; total_searchable counts all vectors. Rank-1 and top-k accuracy in percent, rounded
    to 2; mean reciprocal rank, 0 where none is found, rounded to 4. Nothing to test gives zeros.
    """
    sizes = vectors.where("identifier IS NOT NULL").groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    tested = asked.join(sizes, "identifier", "left_semi")
    q = tested.select(F.col("id").alias("no"), F.lit(None).cast("string").alias("grp"), F.col("embedding").alias("vec"))
    r = vectors.select("id", F.lit(None).cast("string").alias("grp"), F.col("embedding").alias("vec"))
    own = tested.select(F.col("id").alias("query"), F.col("identifier").alias("own"))
    near = exact_knn(q, r, k).join(vectors.select("id", "identifier"), "id")
    hits = own.join(near, "query", "left").groupBy("query").agg(F.min(F.when(F.col("identifier") == F.col("own"), F.col("rank"))).alias("first_rank"))
    rate = lambda c: F.coalesce(F.round(F.avg(c.cast("int")) * 100, 2), F.lit(0.0))
    hit = lambda most: F.coalesce(F.col("first_rank") <= most, F.lit(False))
    metrics = hits.agg(
        F.count(F.lit(1)).alias("total_tested"),
        vectors.agg(F.count(F.lit(1))).scalar().alias("total_searchable"),
        rate(hit(1)).alias("rank1_accuracy"),
        rate(hit(k)).alias("top5_accuracy"),
        F.coalesce(F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))), 4), F.lit(0.0)).alias("mrr"),
    )
    return hits, metrics
