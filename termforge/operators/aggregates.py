"""Counts and collections over entries, tags and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions.modes import Mode
from termforge.operators.filters import mode_filter


def entries_num(entries: DataFrame) -> DataFrame:
    return entries.groupBy("dictionary_id").agg(F.count_if(F.col("mode") != int(Mode.BLACK)).alias("entries_num"))


def mode_counts(entries: DataFrame) -> DataFrame:
    one = lambda m: F.count_if(F.col("mode") == int(m)).alias(f"num_{m.name.lower()}")
    return entries.groupBy("dictionary_id").agg(*[one(m) for m in (Mode.GRAY, Mode.WHITE, Mode.BLACK, Mode.AUTO_EXPANDED)])


def distinct_identifiers(entries: DataFrame) -> DataFrame:
    return mode_filter(entries, Mode.ACTIVE).groupBy("dictionary_id").agg(F.count_distinct("identifier").alias("n_identifiers"))


def distinct_norm2(entries: DataFrame) -> DataFrame:
    """What an n-gram index holds: distinct non-null norm2 of active entries per dictionary."""
    return mode_filter(entries, Mode.ACTIVE).where("norm2 IS NOT NULL").select("dictionary_id", "norm2").distinct()


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, 2))


def embedding_coverage(entries: DataFrame, vector: Column) -> DataFrame:
    counts = entries.groupBy("dictionary_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(vector).alias("with_embedding"))
    return counts.select(
        "dictionary_id",
        "total",
        "with_embedding",
        (F.col("total") - F.col("with_embedding")).alias("without_embedding"),
        percent(F.col("with_embedding"), F.col("total")).alias("coverage"),
    )


def embed_summary(semantic: DataFrame) -> DataFrame:
    counts = semantic.groupBy("dictionary_id").agg(
        F.count_if(F.col("embedding").isNotNull()).alias("total_with_embeddings"),
        F.count_if(F.col("embedding").isNotNull() & F.col("searchable")).alias("searchable"),
        F.count(F.lit(1)).alias("total"),
    )
    n = F.col("total_with_embeddings")
    return counts.select(
        "dictionary_id",
        "total_with_embeddings",
        F.col("searchable"),
        (n - F.col("searchable")).alias("non_searchable"),
        percent(F.col("searchable"), n).alias("searchable_percent"),
        percent(n - F.col("searchable"), n).alias("non_searchable_percent"),
        percent(n, F.col("total")).alias("success_rate"),
    )


def cluster_sizes(entries: DataFrame, least: int) -> DataFrame:
    return entries.where("identifier IS NOT NULL").groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def labels_by_identifier(entries: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Labels with their dictionary's name, collected per identifier in a fixed order."""
    named = dictionaries.select(F.col("id").alias("dictionary_id"), F.col("name").alias("dictionary"))
    rows = entries.where("identifier IS NOT NULL").join(named, "dictionary_id")
    return rows.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("label", "dictionary"))).alias("labels"))


def tag_concat(entries: DataFrame, entry_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag values of each entry that has any, joined by commas in order of the tag's id; a tag given twice counts once."""
    given = entry_tags.distinct().join(tags.select(F.col("id").alias("tag_id"), "value"), "tag_id")
    joined = given.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("tag_id", "value"))).alias("t"))
    joined = joined.select("entry_id", F.array_join(F.transform("t", lambda x: x["value"]), ",").alias("tags"))
    return entries.join(joined, entries["id"] == joined["entry_id"]).select("id", "tags")


def stopword_usage(entries: DataFrame, words: list[str], name: str = "unused") -> DataFrame:
    """Per dictionary the words that occur in none of its labels, as whole lower-cased pieces between white space; words keep their order."""
    used = entries.where("label IS NOT NULL").select("dictionary_id", F.explode(F.split(F.lower("label"), r"\s+")).alias("w"))
    used = used.where(F.col("w").isin(words)).distinct().groupBy("dictionary_id").agg(F.collect_set("w").alias("used"))
    every = entries.select("dictionary_id").distinct().join(used, "dictionary_id", "left")
    listed = F.array(*[F.lit(w) for w in words])
    return every.select("dictionary_id", F.coalesce(F.array_except(listed, F.col("used")), listed).alias(name))


def stopword_lists(entries: DataFrame, no_term: list[str], no_begin: list[str], no_end: list[str]) -> DataFrame:
    """Stop-word lists after compiling: words used anywhere, first or last in a label leave the list in question. Entries without dictionary are left out."""
    entries = entries.where("dictionary_id IS NOT NULL")
    t = F.split(F.trim(F.lower("label")), r"\s+")
    per = entries.where("label IS NOT NULL").select(
        "dictionary_id", t.alias("t"), F.element_at(t, 1).alias("first"), F.element_at(t, -1).alias("last")
    )
    hit = per.select(
        "dictionary_id",
        F.explode(
            F.array_union(
                F.transform("t", lambda w: F.struct(F.lit("no_term_words").alias("list"), w.alias("w"))),
                F.array(
                    F.struct(F.lit("no_begin_words").alias("list"), F.col("first").alias("w")), F.struct(F.lit("no_end_words").alias("list"), F.col("last").alias("w"))
                ),
            )
        ).alias("x"),
    ).select("dictionary_id", "x.list", "x.w")
    lists = {"no_term_words": no_term, "no_begin_words": no_begin, "no_end_words": no_end}
    keep = F.lit(False)
    for n, words in lists.items():
        keep = keep | ((F.col("list") == n) & F.col("w").isin(words))
    used = hit.where(keep).groupBy("dictionary_id").agg(*[F.collect_set(F.when(F.col("list") == n, F.col("w"))).alias(n) for n in lists])
    every = entries.select("dictionary_id").distinct().join(used, "dictionary_id", "left")

    def rest(n: str, words: list[str]) -> Column:
        full = F.array(*[F.lit(w) for w in dict.fromkeys(words)])
        return F.coalesce(F.array_except(full, F.col(n)), full).alias(n)

    return every.select("dictionary_id", *[rest(n, w) for n, w in lists.items()])
