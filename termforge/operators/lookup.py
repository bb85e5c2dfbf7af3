"""Labels to identifiers, identifiers to labels, and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions.similarity import scored, str_sim
from termforge.functions.vectors import cosine_distance, usable
from termforge.operators.filters import with_any_tag, without_black
from termforge.operators.ngram import similarity_join
from termforge.session import spread

MATCH = ["label", "dictionary_id", "entry_id", "identifier", "entry_label", "norm1", "norm2", "score", "search_type"]


def find_dictionaries(dictionaries: DataFrame, names: list[str]) -> DataFrame:
    """Dictionaries by name, in the order of names and as often as named; unknown names raise a ValueError."""
    spark = dictionaries.sparkSession
    asked = spark.createDataFrame(list(enumerate(names)), "pos int, asked string")
    found = asked.join(dictionaries, asked["asked"] == dictionaries["name"], "left")
    missing = [r.asked for r in found.where("name IS NULL").select("asked", "pos").orderBy("pos").distinct().collect()]
    if missing:
        raise ValueError(f"unknown dictionary: {', '.join(dict.fromkeys(missing))}.")
    return found.orderBy("pos").drop("asked")


def scoped(entries: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Lookup scope: entries of the dictionaries that aren't black, with each dictionary's threshold and language."""
    d = dictionaries.select(F.col("id").alias("dictionary_id"), F.col("threshold").alias("own_threshold"), "language")
    e = without_black(entries).select(
        F.col("id").alias("entry_id"), "dictionary_id", F.col("label").alias("entry_label"), "identifier", F.col("norm1").alias("e1"), F.col("norm2").alias("e2")
    )
    return e.join(d, "dictionary_id")


def match_exact(labels: DataFrame, entries: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Entries with the very label; score 1."""
    e = scoped(entries, dictionaries)
    m = labels.join(e, labels["label"] == e["entry_label"])
    return m.select(
        "label", "dictionary_id", "entry_id", "identifier", "entry_label", F.col("e1").alias("norm1"), F.col("e2").alias("norm2"), F.lit(1.0).alias("score"), F.lit("Surface").alias("search_type")
    )


def match_soft(labels: DataFrame, entries: DataFrame, dictionaries: DataFrame, threshold: float | None = None, ngram: bool = False, language_measure: bool = True) -> DataFrame:
    """Entries whose norm2 equals that of the label, or with ngram is similar enough to it, and whose string similarity reaches the threshold.

    labels: (label, norm1, norm2). Without a threshold each dictionary's own counts. Null norms match nothing.
    """
    e = scoped(spread(without_black(entries), "id"), dictionaries).where("e2 IS NOT NULL AND e1 IS NOT NULL")
    limit = F.lit(threshold) if threshold is not None else F.col("own_threshold")
    asked = labels.where("norm2 IS NOT NULL AND norm1 IS NOT NULL AND norm2 <> ''")
    if ngram:
        least = threshold if threshold is not None else float(dictionaries.agg(F.coalesce(F.min("threshold"), F.lit(0.85))).first()[0])
        near = similarity_join(asked, "norm2", e, "e2", least).select(F.col("left").alias("norm2"), F.col("right").alias("e2"))
        m = asked.join(near, "norm2").join(e, "e2")
    else:
        m = asked.join(e, asked["norm2"] == e["e2"])
    language = F.col("language") if language_measure else F.lit("eng")
    score = str_sim(language, F.col("label"), F.col("entry_label"), F.col("norm1"), F.col("e1"), F.col("norm2"), F.col("e2"))
    m = scored(m, score).where(F.col("score") >= limit)
    return m.select("label", "dictionary_id", "entry_id", "identifier", "entry_label", F.col("e1").alias("norm1"), F.col("e2").alias("norm2"), "score", F.lit("Surface").alias("search_type"))


def combined(surface: DataFrame, semantic: DataFrame) -> DataFrame:
    """Surface matches, then semantic ones of other identifiers: one match per label, dictionary and identifier."""
    both = surface.withColumn("o", F.lit(0)).unionByName(semantic.withColumn("o", F.lit(1)))
    order = Window.partitionBy("label", "dictionary_id", "identifier").orderBy("o", F.desc("score"), "entry_id")
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").drop("o", "r")


def top_ties(matches: DataFrame) -> DataFrame:
    """Per label all matches of the best score."""
    best = F.max("score").over(Window.partitionBy("label"))
    return matches.withColumn("best", best).where(F.col("score") == F.col("best")).drop("best")


def in_order() -> list[Column]:
    return [F.desc("score"), F.asc("dictionary_id"), F.asc("identifier"), F.asc("entry_label"), F.asc("entry_id")]


def top_order(matches: DataFrame) -> DataFrame:
    """All matches with their rank by score; ties by dictionary, identifier, label and id."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*in_order())))


def find_ids(
    labels: DataFrame,
    entries: DataFrame,
    dictionaries: DataFrame,
    threshold: float | None = None,
    superfluous: bool = False,
    ngram: bool = False,
    semantic: DataFrame | None = None,
    tags: list[str] | None = None,
    entry_tags: DataFrame | None = None,
    tag_table: DataFrame | None = None,
) -> DataFrame:
    """(label, identifiers): identifiers of every asked label, best first; a label without match has an empty list.

    labels: (label[, norm1, norm2]); repeated labels count once. threshold 1 and more compares labels exactly. superfluous keeps all matches
    in order of score, else those that tie for the best. semantic: matches from vectors, in the columns of MATCH. tags keeps entries with
    at least one of the values.
    """
    asked = labels.where("label IS NOT NULL AND label <> ''").dropDuplicates(["label"])
    if tags:
        entries = with_any_tag(entries, entry_tags, tag_table, tags)
    m = match_exact(asked, entries, dictionaries) if threshold is not None and threshold >= 1 else match_soft(asked, entries, dictionaries, threshold, ngram)
    if semantic is not None:
        m = combined(m, semantic)
    m = top_order(m if superfluous else top_ties(m))
    lists = m.where("identifier IS NOT NULL").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "identifier"))).alias("m"))
    ids = F.coalesce(F.array_distinct(F.transform("m", lambda x: x["identifier"])), F.array().cast("array<string>"))
    every = labels.where("label IS NOT NULL").select("label").distinct()
    return every.join(lists, "label", "left").select("label", ids.alias("identifiers"))


def first_ids(found: DataFrame) -> DataFrame:
    """Per label the first identifier, empty where there is none: the cells of one CSV line."""
    return found.select("label", F.coalesce(F.try_element_at("identifiers", F.lit(1)), F.lit("")).alias("identifier"))


def find_terms(ids: DataFrame, entries: DataFrame, dictionaries: DataFrame, verbose: bool = True) -> DataFrame:
    """(identifier, labels): labels with the names of their dictionaries, of all modes; unknown identifiers are left out. Not verbose: the first only."""
    names = dictionaries.select(F.col("id").alias("dictionary_id"), F.col("name").alias("dictionary"))
    asked = ids.select("identifier").where("identifier IS NOT NULL").distinct()
    rows = entries.select("identifier", "label", "dictionary_id").join(asked, "identifier").join(names, "dictionary_id")
    if verbose:
        return rows.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("label", "dictionary"))).alias("labels"))
    first = F.min(F.struct("label", "dictionary"))
    return rows.groupBy("identifier").agg(first.alias("m")).select("identifier", "m.label", "m.dictionary")


def semantic_single(entries: DataFrame, vector: list[float], threshold: float, strict_searchable: bool = False, k: int = 5) -> DataFrame:
    """The k nearest entries to one vector within distance 1 - threshold. Unsearchable entries count too, unless strict_searchable."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    rows = entries.where(usable(F.col("embedding"), len(vector)))
    rows = rows.where("searchable") if strict_searchable else rows
    d = rows.withColumn("distance", cosine_distance(F.col("embedding"), q)).where(F.col("distance") <= 1 - threshold)
    return d.orderBy("distance", "id").limit(k)
