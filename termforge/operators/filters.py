"""Scopes, predicates, orders and pages over entries, dictionaries and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions.modes import Mode

PER_PAGE = 15


def mode_filter(entries: DataFrame, mode: Mode) -> DataFrame:
    """Entries of a stored mode, or of the modes that a query-only mode stands for. Null modes never match."""
    modes = {Mode.ACTIVE: [Mode.GRAY, Mode.WHITE], Mode.CUSTOM: [Mode.WHITE, Mode.BLACK]}.get(mode, [mode])
    return entries.where(F.col("mode").isin([int(m) for m in modes]))


def auto_expanded(entries: DataFrame) -> DataFrame:
    return mode_filter(entries, Mode.AUTO_EXPANDED).orderBy(F.desc_nulls_first("score"), "id")


def without_black(entries: DataFrame) -> DataFrame:
    """The scope of lookups; rows with a null mode drop out."""
    return entries.where(F.col("mode") != int(Mode.BLACK))


def additional(entries: DataFrame) -> DataFrame:
    """White entries that have not been compiled yet."""
    return entries.where((F.col("mode") == int(Mode.WHITE)) & F.col("dirty"))


def searchable(entries: DataFrame) -> DataFrame:
    return entries.where("searchable")


def like_contains(c: Column, q: str) -> Column:
    return c.like(f"%{q}%")


def narrow_by_label(entries: DataFrame, norm: str) -> DataFrame:
    """Entries whose norm1 contains the norm; % and _ in it keep their meaning. Shorter labels first."""
    return entries.where(like_contains(F.col("norm1"), norm)).orderBy(F.asc_nulls_last("label_length"), "id")


def narrow_by_label_prefix(entries: DataFrame, norm: str, strict: bool = False) -> DataFrame:
    """As narrow_by_label(), which is what users of prefix completion get; strict keeps true prefixes only."""
    found = entries.where(F.col("norm1").startswith(norm)) if strict else entries.where(like_contains(F.col("norm1"), norm))
    return found.orderBy(F.asc_nulls_last("label_length"), "id")


def narrow_by_label_mixed(entries: DataFrame, norm: str) -> DataFrame:
    found = entries.where(F.col("norm1").like(f"{norm}%") | F.col("norm1").like(f"_%{norm}%"))
    return found.orderBy(F.asc_nulls_last("label_length"), "id")


def narrow_by_identifier(entries: DataFrame, q: str) -> DataFrame:
    return entries.where(F.col("identifier").ilike(f"%{q}%"))


def narrow_by_tag(entries: DataFrame, entry_tags: DataFrame, tag_id: int) -> DataFrame:
    """An inner join through the bridge: an entry that carries the tag twice comes twice."""
    bridge = entry_tags.where(F.col("tag_id") == tag_id).select("entry_id")
    return entries.join(bridge, entries["id"] == bridge["entry_id"]).drop("entry_id")


def with_any_tag(entries: DataFrame, entry_tags: DataFrame, tags: DataFrame, values: list[str]) -> DataFrame:
    """Entries with at least one of the tag values, each once. No values: all entries."""
    if not values:
        return entries
    tagged = entry_tags.join(tags.where(F.col("value").isin(values)).select("id"), F.col("tag_id") == F.col("id")).select("entry_id")
    return entries.join(tagged, entries["id"] == tagged["entry_id"], "left_semi")


def page(df: DataFrame, number: int = 1, per: int = PER_PAGE) -> DataFrame:
    """Pages count from 1; page 0 and below is the first."""
    return df.offset((max(number, 1) - 1) * per).limit(per)


def patterns_matching(patterns: DataFrame, expression: str | None = None, identifier: str | None = None) -> DataFrame:
    """Case-insensitive LIKE without wildcards of its own."""
    for c, q in (("expression", expression), ("identifier", identifier)):
        if q is not None:
            patterns = patterns.where(F.col(c).ilike(q))
    return patterns


def active_patterns(patterns: DataFrame, dictionaries: DataFrame) -> DataFrame:
    ids = dictionaries.select(F.col("id").alias("dictionary_id"))
    return patterns.where("active").join(ids, "dictionary_id", "left_semi")


def public(dictionaries: DataFrame) -> DataFrame:
    return dictionaries.where("public")


def _managed(dictionaries: DataFrame, associations: DataFrame, user: int) -> DataFrame:
    mine = associations.where(F.col("user_id") == user).select(F.col("dictionary_id").alias("id")).distinct()
    return dictionaries.join(mine.withColumn("managed", F.lit(True)), "id", "left")


def scope_mine(dictionaries: DataFrame, associations: DataFrame, user: int | None) -> DataFrame:
    """Dictionaries that the user owns or manages; none for nobody."""
    if user is None:
        return dictionaries.where("false")
    return _managed(dictionaries, associations, user).where((F.col("user_id") == user) | F.col("managed")).drop("managed")


def scope_visible(dictionaries: DataFrame, associations: DataFrame, user: int | None, admin: bool = False) -> DataFrame:
    if user is None:
        return public(dictionaries)
    if admin:
        return dictionaries
    return _managed(dictionaries, associations, user).where(F.col("public") | (F.col("user_id") == user) | F.col("managed")).drop("managed")


def scope_editable(dictionaries: DataFrame, associations: DataFrame, user: int | None, admin: bool = False) -> DataFrame:
    return dictionaries if admin and user is not None else scope_mine(dictionaries, associations, user)


def scope_administrable(dictionaries: DataFrame, user: int | None, admin: bool = False) -> DataFrame:
    if user is None:
        return dictionaries.where("false")
    return dictionaries if admin else dictionaries.where(F.col("user_id") == user)


def dictionary_state(dictionaries: DataFrame, entries: DataFrame, entry_tags: DataFrame, semantic_ids: DataFrame, running: DataFrame) -> DataFrame:
    """State flags of every dictionary from what it holds now.

    semantic_ids: (dictionary_id) of entries with a vector; running: (dictionary_id) of unfinished jobs.
    """
    tagged = entry_tags.select(F.col("entry_id").alias("id")).distinct().withColumn("tagged", F.lit(True))
    of = (
        entries.select("id", "dictionary_id", "mode", "dirty")
        .join(tagged, "id", "left")
        .groupBy("dictionary_id")
        .agg(
            F.count_if(F.col("mode") != int(Mode.BLACK)).alias("n"),
            F.coalesce(F.bool_or("tagged"), F.lit(False)).alias("use_tags"),
            F.coalesce(F.bool_or((F.col("mode") == int(Mode.WHITE)) & F.col("dirty")), F.lit(False)).alias("compilable"),
        )
    )
    busy = running.groupBy("dictionary_id").agg(F.lit(True).alias("locked"))
    vectors = semantic_ids.groupBy("dictionary_id").agg(F.lit(True).alias("embeddings_populated"))
    d = dictionaries.select(F.col("id").alias("dictionary_id")).join(of, "dictionary_id", "left")
    d = d.join(busy, "dictionary_id", "left").join(vectors, "dictionary_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    n = F.coalesce("n", F.lit(0))
    return d.select(
        "dictionary_id",
        (n == 0).alias("empty"),
        (~F.coalesce("locked", F.lit(False))).alias("stable"),
        ((n == 0) & ~F.coalesce("locked", F.lit(False))).alias("uploadable"),
        yes("locked"),
        yes("use_tags"),
        (n > 10000).alias("large"),
        yes("compilable"),
        yes("embeddings_populated"),
    )
