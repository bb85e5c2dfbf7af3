"""Jobs as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(jobs: DataFrame) -> DataFrame:
    """One row per job of those delivered several times: the one that got furthest."""
    order = Window.partitionBy("id").orderBy(
        F.desc_nulls_last("ended_at"), F.desc_nulls_last("num_dones"), F.desc_nulls_last("begun_at"), F.desc_nulls_last("registered_at"), F.desc_nulls_last("message"), F.desc_nulls_last("metadata")
    )
    return jobs.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def status() -> Column:
    done = F.when(F.col("ended_at").isNotNull(), "done").when(F.col("begun_at").isNotNull(), "in_progress").otherwise("in_queue")
    return F.when(F.length("message") > 0, "error").otherwise(done)


def waiting(jobs: DataFrame) -> DataFrame:
    return jobs.where("begun_at IS NULL")


def running(jobs: DataFrame) -> DataFrame:
    return jobs.where("begun_at IS NOT NULL AND ended_at IS NULL")


def unfinished(jobs: DataFrame) -> DataFrame:
    return jobs.where("ended_at IS NULL")


def finished(jobs: DataFrame) -> DataFrame:
    return jobs.where("ended_at IS NOT NULL")


def queue_totals(jobs: DataFrame) -> DataFrame:
    """Seconds and number of jobs not begun yet, per queue."""
    return waiting(jobs).groupBy("queue_name").agg(F.coalesce(F.sum("time"), F.lit(0)).alias("seconds"), F.count(F.lit(1)).alias("n_jobs"))


def etr(jobs: DataFrame, now: Column) -> DataFrame:
    """Estimated seconds to the end: of queued jobs from the queue, of running ones from their speed, else 5."""
    queues = queue_totals(jobs).withColumnRenamed("seconds", "queue_seconds").drop("n_jobs")
    elapsed = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("begun_at").cast("timestamp"))
    left = (F.col("num_items") - F.col("num_dones")) / ((F.col("num_dones") / F.nullif(elapsed, F.lit(0))) * 2)
    value = F.when(status() == "in_queue", F.coalesce("queue_seconds", F.lit(0)) / 4 + F.col("time"))
    value = value.when((status() == "in_progress") & (F.col("num_dones") > 0) & left.isNotNull(), left).otherwise(F.lit(5.0))
    return jobs.join(queues, "queue_name", "left").select("id", status().alias("status"), value.alias("etr"))


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("name") == "Text annotation") & (F.col("ended_at") < now - F.expr("interval 1 day")))


def duration_words(seconds: Column) -> Column:
    """Days, hours, minutes and seconds; leading parts that are zero are left out."""
    parts = [(F.floor(seconds / 86400), "d"), (F.floor(seconds / 3600) % 24, "h"), (F.floor(seconds / 60) % 60, "m")]
    words, before = [], seconds < 0
    for n, unit in parts:
        before = before | (n > 0)
        words.append(F.when(before, F.concat(n.cast("string"), F.lit(unit))))
    return F.concat_ws(" ", *words, F.concat((F.floor(seconds) % 60).cast("string"), F.lit("s")))


def time_estimate(chars: Column) -> Column:
    return F.lit(1.0) + chars * 0.00001


def description(jobs: DataFrame) -> DataFrame:
    """(id, key, value) rows of each job's description."""
    shown = ["name", "dictionary_id", "num_items", "num_dones", "queue_name", "message"]
    cast = jobs.select("id", status().alias("status"), *[F.col(c).cast("string").alias(c) for c in shown])
    return cast.unpivot("id", ["status", *shown], "key", "value").where("value IS NOT NULL")


def last_completed(jobs: DataFrame, name: str) -> DataFrame:
    """Per dictionary the last finished job of a name."""
    order = Window.partitionBy("dictionary_id").orderBy(F.desc("ended_at"), "id")
    done = finished(jobs).where(F.col("name") == name)
    return done.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
