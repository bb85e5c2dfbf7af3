"""Whole jobs on one dictionary: loading a file, compiling, embedding, each with a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.functions.stopwords import EDGE_WORDS, NO_TERM_WORDS
from termforge.functions.vectors import usable
from termforge.operators import analysis, edits
from termforge.operators.aggregates import stopword_lists
from termforge.operators.ngram import postings
from termforge.session import new_path, written
from termforge.sources import entry_file

REPORTED = 100


@dataclass(frozen=True)
class Loaded:
    entries: DataFrame  # to be appended
    tags: DataFrame
    entry_tags: DataFrame
    skipped: DataFrame  # file, line_no, line, reason: every label of too many words, and the first REPORTED lines that are no entries
    report: DataFrame  # one row: n_lines, n_entries, n_skipped


def load(spark: SparkSession, path: str, entries: DataFrame, tags: DataFrame, dictionary_id: int, reported: int = REPORTED) -> Loaded:
    """A file, or a folder of files, of entries into a dictionary that has none but black ones, else a ValueError.

    Equal entries of the file come in once, with the tags of the first; entries that break a rule are left out and reported. A tag list of
    another form than names joined by commas ends the load. Lines are numbered within their file.
    """
    entry_file.require_empty(entries, dictionary_id)
    file = entry_file.read_entries(spark, path)
    added, new_tags, entry_tags = edits.bulk_insert(entries, written(file.entries, "load"), tags, dictionary_id)
    added = written(added, "loaded")
    rejected = written(file.rejected, "rejected")
    too_long = rejected.where("reason = 'token_limit'")
    first = rejected.where("reason <> 'token_limit'").orderBy("file", "line_no").limit(reported)
    n = added.agg(F.count(F.lit(1)).alias("n_entries"))
    bad = rejected.agg(F.count(F.lit(1)).alias("n_skipped"))
    lines = spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))
    return Loaded(added, new_tags, entry_tags, too_long.unionByName(first), lines.crossJoin(n).crossJoin(bad))  # three single rows


@dataclass(frozen=True)
class Compiled:
    entries: DataFrame  # white ones no longer dirty
    postings: DataFrame  # dictionary_id, norm2, n_grams, gram: the n-gram index, as stored
    stop_words: DataFrame  # dictionary_id, no_term_words, no_begin_words, no_end_words, as stored
    folder: str


def compile_dictionaries(entries: DataFrame, folder: str | None = None, n: int = 3) -> Compiled:
    """N-gram index of the norms of active entries and stop words that no label needs, per dictionary, stored under a folder.

    The index is split by dictionary in its files' order, so that one dictionary's is read without the others. A folder that holds an older
    index gets the new one.
    """
    at = folder or new_path(entries.sparkSession, "index")
    spark = entries.sparkSession
    active = entries.where("mode IN (0, 1) AND dictionary_id IS NOT NULL AND length(norm2) > 0").select("dictionary_id", "norm2")
    index = active.distinct().join(postings(active, "norm2", n), "norm2")
    index.select("dictionary_id", "norm2", "n_grams", "gram").sortWithinPartitions("dictionary_id", "gram").write.mode("overwrite").parquet(f"{at}/postings")
    stopword_lists(entries, NO_TERM_WORDS, EDGE_WORDS, EDGE_WORDS).write.mode("overwrite").parquet(f"{at}/stop_words")
    return Compiled(edits.compile_dictionary(entries), spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/stop_words"), at)


def with_stop_words(dictionaries: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Dictionaries with their stop words as compiled; those that weren't keep theirs."""
    names = ["no_term_words", "no_begin_words", "no_end_words"]
    new = stop_words.select(F.col("dictionary_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = dictionaries.join(new, "id", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in names}).select(dictionaries.columns)


@dataclass(frozen=True)
class Embedded:
    semantic: DataFrame
    entries: DataFrame  # with searchable as set anew
    failed: DataFrame  # id, label
    report: DataFrame  # one row: total, completed, failed, success_rate in percent, n_outliers


def update_embeddings(
    entries: DataFrame,
    semantic: DataFrame,
    dictionary_id: int,
    embed: Callable[[str], Column],
    dim: int,
    origins: DataFrame | None = None,
    two_stage: bool = False,
    below: float = 0.75,
    z_most: float = 2.0,
    least: int = 3,
) -> Embedded:
    """Vectors of all entries of a dictionary made anew and put into its semantic table.

    All entries become searchable but black ones. An entry whose label is null or for which the embedder gives no usable vector of `dim`
    numbers is a failed one, keeps its former vector, and is reported. With origins, outliers near their vectors, and with two_stage
    those within clusters too, are made unsearchable in the semantic table.
    """
    here = edits.reset_searchable(entries.where(F.col("dictionary_id") == dictionary_id))
    made = written(here.select("id", "dictionary_id", "label", "identifier", "searchable", embed("label").alias("embedding")), "embedded")
    good = F.coalesce(F.col("label").isNotNull() & usable(F.col("embedding"), dim), F.lit(False))
    kind = semantic.schema["embedding"].dataType
    table = edits.upsert(semantic, made.where(good).withColumn("embedding", F.col("embedding").cast(kind)))
    flags = here.select("id", F.col("searchable").alias("__now"))
    table = table.join(flags, "id", "left").withColumn("searchable", F.coalesce("__now", "searchable")).drop("__now").select(semantic.columns)
    n_outliers = F.lit(0).cast("long")
    if origins is not None:
        clean = analysis.clean_two_stage(table, origins, dim, below, z_most, least, False) if two_stage else analysis.clean_by_origin(table, origins, dim, below, dry_run=False)
        outliers = written(clean.outliers.select("id").distinct(), "outliers")
        table = analysis.with_flags(table, outliers, False)
        n_outliers = outliers.agg(F.count(F.lit(1))).scalar()
    done = F.count_if(good)
    rate = F.coalesce(F.round(done / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 2), F.lit(0.0))
    report = made.agg(F.count(F.lit(1)).alias("total"), done.alias("completed"), F.count_if(~good).alias("failed"), rate.alias("success_rate"))
    rest = entries.where(~F.coalesce(F.col("dictionary_id") == dictionary_id, F.lit(False))).unionByName(here)
    return Embedded(table, rest, made.where(~good).select("id", "label"), report.withColumn("n_outliers", n_outliers))


def update_context(before: DataFrame, after: DataFrame, embed: Callable[[str], Column]) -> DataFrame:
    """Dictionaries with context_embedding made anew where the description changed; null for a null or blank one. Others keep theirs."""
    old = before.select("id", F.col("description").alias("__old"))
    joined = after.join(old, "id", "left")
    changed = ~F.col("description").eqNullSafe(F.col("__old"))
    todo = written(joined.where(changed).drop("__old"), "contexts")
    kind = after.schema["context_embedding"].dataType
    text = F.col("description")
    fresh = todo.withColumn("context_embedding", F.when(text.isNotNull() & (F.trim(text) != ""), embed("description")).cast(kind))
    return joined.where(~changed).select(after.columns).unionByName(fresh.select(after.columns))
