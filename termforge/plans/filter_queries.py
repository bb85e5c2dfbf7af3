"""Scopes, predicates, pages and projections over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions.modes import Mode
from termforge.operators import filters as f
from termforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NORM, IDENT, USER = "syndrom", "ana", 5
TAGS = ["Chemistry", "medicine", "no_such_tag"]
ENTRY = ["id", "dictionary_id", "label", "identifier", "mode"]
ENTRY_SQL = "id, dictionary_id, label, identifier, mode"


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def entries(run: Callable[[DataFrame], DataFrame], columns: list[str] = ENTRY) -> Query:
    return lambda s, d: run(table(s, d, "entries")).select(*columns)


def associations(s: SparkSession, d: str) -> DataFrame:
    """Managers, for which there is no table: the owner of dictionary n also manages dictionary n + 1."""
    return table(s, d, "dictionaries").select("user_id", (F.col("id") % 240 + 1).alias("dictionary_id"))


def patterns(s: SparkSession, d: str) -> DataFrame:
    """Patterns, for which there is no table: a word per tag; every fifth is switched off."""
    t = table(s, d, "tags")
    return t.select("id", "dictionary_id", F.concat(F.lit(r"\b"), F.lower("value"), F.lit(r"\w*\b")).alias("expression"), F.concat(F.lit("TAG:"), F.col("id").cast("string")).alias("identifier"), (F.col("id") % 5 != 0).alias("active"))


PATTERNS_SQL = r"(SELECT id, dictionary_id, '\b' || lower(value) || '\w*\b' AS expression, 'TAG:' || id AS identifier, id % 5 <> 0 AS active FROM tags)"
ASSOC_SQL = "(SELECT user_id, id % 240 + 1 AS dictionary_id FROM dictionaries)"

for name, mode, cond in [
    ("flt_mode_gray", Mode.GRAY, "mode = 0"),
    ("flt_mode_white", Mode.WHITE, "mode = 1"),
    ("flt_mode_black", Mode.BLACK, "mode = 2"),
    ("flt_mode_custom", Mode.CUSTOM, "mode IN (1, 2)"),
    ("flt_mode_active", Mode.ACTIVE, "mode IN (0, 1)"),
]:
    add(name, entries(lambda e, m=mode: f.mode_filter(e, m)), f"SELECT {ENTRY_SQL} FROM entries WHERE {cond}")

add("flt_auto_expanded", entries(f.auto_expanded, [*ENTRY, "score"]), f"SELECT {ENTRY_SQL}, score FROM entries WHERE mode = 6")
add("flt_without_black", entries(f.without_black), f"SELECT {ENTRY_SQL} FROM entries WHERE mode <> 2")
add("flt_additional", entries(f.additional), f"SELECT {ENTRY_SQL} FROM entries WHERE mode = 1 AND dirty")
add("flt_label_substring", entries(lambda e: f.narrow_by_label(e, NORM)), f"SELECT {ENTRY_SQL} FROM entries WHERE norm1 LIKE '%{NORM}%'")
add("flt_label_prefix", entries(lambda e: f.narrow_by_label_prefix(e, "acute")), f"SELECT {ENTRY_SQL} FROM entries WHERE norm1 LIKE '%acute%'")
add("flt_label_prefix_strict", entries(lambda e: f.narrow_by_label_prefix(e, "acute", True)), f"SELECT {ENTRY_SQL} FROM entries WHERE norm1 LIKE 'acute%'")
add("flt_label_mixed", entries(lambda e: f.narrow_by_label_mixed(e, "gene")), f"SELECT {ENTRY_SQL} FROM entries WHERE norm1 LIKE 'gene%' OR norm1 LIKE '_%gene%'")
add("flt_identifier_ilike", entries(lambda e: f.narrow_by_identifier(e, IDENT)), f"SELECT {ENTRY_SQL} FROM entries WHERE identifier ILIKE '%{IDENT}%'")
add(
    "flt_tag",
    lambda s, d: f.narrow_by_tag(table(s, d, "entries"), table(s, d, "entry_tags"), 153).select(*ENTRY),
    f"SELECT {ENTRY_SQL} FROM entries JOIN entry_tags ON id = entry_id WHERE tag_id = 153",
)
_TAGGED = "EXISTS (SELECT 1 FROM entry_tags x JOIN tags t ON t.id = x.tag_id WHERE x.entry_id = entries.id AND t.value IN ('Chemistry', 'medicine', 'no_such_tag'))"
tagged: Query = lambda s, d: f.with_any_tag(table(s, d, "entries"), table(s, d, "entry_tags"), table(s, d, "tags"), TAGS).select(*ENTRY)
add("flt_tags_exists", tagged, f"SELECT {ENTRY_SQL} FROM entries WHERE {_TAGGED}")
add("join_semi_tags", lambda s, d: tagged(s, d).groupBy("dictionary_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT dictionary_id, count(*) AS n FROM entries WHERE {_TAGGED} GROUP BY 1")
add("flt_pattern_ilike", lambda s, d: f.patterns_matching(patterns(s, d), r"\\b%e%", "tag:%1%"), rf"SELECT * FROM {PATTERNS_SQL} WHERE expression ILIKE '\b%e%' AND identifier ILIKE 'tag:%1%'")
add(
    "flt_active_patterns",
    lambda s, d: f.active_patterns(patterns(s, d), f.public(table(s, d, "dictionaries"))),
    f"SELECT * FROM {PATTERNS_SQL} WHERE active AND dictionary_id IN (SELECT id FROM dictionaries WHERE public)",
)
add("flt_searchable", entries(f.searchable), f"SELECT {ENTRY_SQL} FROM entries WHERE searchable")
add("flt_public", lambda s, d: f.public(table(s, d, "dictionaries")).select("id", "name"), "SELECT id, name FROM dictionaries WHERE public")
_MANAGED = f"id IN (SELECT dictionary_id FROM {ASSOC_SQL} WHERE user_id = {USER})"
scope = lambda run: lambda s, d: run(table(s, d, "dictionaries"), associations(s, d)).select("id", "name")
add("flt_scope_mine", scope(lambda a, b: f.scope_mine(a, b, USER)), f"SELECT id, name FROM dictionaries WHERE user_id = {USER} OR {_MANAGED}")
add("flt_scope_visible", scope(lambda a, b: f.scope_visible(a, b, USER)), f"SELECT id, name FROM dictionaries WHERE public OR user_id = {USER} OR {_MANAGED}")
add("flt_scope_visible_anonymous", scope(lambda a, b: f.scope_visible(a, b, None)), "SELECT id, name FROM dictionaries WHERE public")
add("flt_scope_editable", scope(lambda a, b: f.scope_editable(a, b, USER)), f"SELECT id, name FROM dictionaries WHERE user_id = {USER} OR {_MANAGED}")
add("flt_scope_administrable", scope(lambda a, b: f.scope_administrable(a, USER)), f"SELECT id, name FROM dictionaries WHERE user_id = {USER}")
add(
    "join_left_access",
    lambda s, d: table(s, d, "dictionaries").select("id", "name").join(associations(s, d).withColumnRenamed("user_id", "manager"), F.col("id") == F.col("dictionary_id"), "left").select("id", "name", "manager"),
    f"SELECT id, name, manager FROM dictionaries LEFT JOIN (SELECT user_id AS manager, dictionary_id FROM {ASSOC_SQL}) a ON id = a.dictionary_id",
)
add(
    "flt_dictionary_state",
    lambda s, d: f.dictionary_state(
        table(s, d, "dictionaries"),
        table(s, d, "entries"),
        table(s, d, "entry_tags"),
        table(s, d, "entries").where("embedding IS NOT NULL").select("dictionary_id").unionByName(table(s, d, "semantic_dict_16").select("dictionary_id")),
        table(s, d, "jobs").where("ended_at IS NULL AND dictionary_id IS NOT NULL").select("dictionary_id"),
    ),
    """WITH e AS (SELECT dictionary_id, count(*) FILTER (mode <> 2) AS n, coalesce(bool_or(id IN (SELECT entry_id FROM entry_tags)), false) AS use_tags,
        coalesce(bool_or(mode = 1 AND dirty), false) AS compilable FROM entries GROUP BY 1),
      l AS (SELECT DISTINCT dictionary_id FROM jobs WHERE ended_at IS NULL),
      v AS (SELECT dictionary_id FROM entries WHERE embedding IS NOT NULL UNION SELECT dictionary_id FROM semantic_dict_16),
      x AS (SELECT d.id AS dictionary_id, coalesce(n, 0) AS n, coalesce(use_tags, false) AS use_tags, coalesce(compilable, false) AS compilable,
        d.id IN (SELECT dictionary_id FROM l WHERE dictionary_id IS NOT NULL) AS locked, d.id IN (SELECT dictionary_id FROM v WHERE dictionary_id IS NOT NULL) AS embeddings_populated
        FROM dictionaries d LEFT JOIN e ON e.dictionary_id = d.id)
      SELECT dictionary_id, n = 0 AS empty, NOT locked AS stable, n = 0 AND NOT locked AS uploadable, locked, use_tags, n > 10000 AS large, compilable, embeddings_populated FROM x""",
)
add(
    "flt_span_semantic",
    lambda s, d: _worth(table(s, d, "entries")),
    r"SELECT DISTINCT label FROM entries WHERE length(label) >= 3 AND NOT regexp_full_match(label, '[0-9.\-+,\s]+')",
)
add("prj_entry_json", entries(lambda e: e.select(F.col("id").alias("entry_id"), F.col("identifier").alias("id"), "label"), ["entry_id", "id", "label"]), "SELECT id AS entry_id, identifier AS id, label FROM entries")
_TAGLIST = """(SELECT entry_id, string_agg(value, ',' ORDER BY tag_id) AS tags FROM (SELECT DISTINCT entry_id, tag_id FROM entry_tags) x
    JOIN (SELECT id AS tag_id, value FROM tags) t USING (tag_id) GROUP BY entry_id)"""
add("prj_result_hash", lambda s, d: _result_hash(s, d), f"SELECT id, label, norm1, norm2, identifier, tags FROM entries LEFT JOIN {_TAGLIST} ON id = entry_id")
add("pg_simple", entries(lambda e: f.page(e.orderBy("id"), 3, 15)), f"SELECT {ENTRY_SQL} FROM entries ORDER BY id LIMIT 15 OFFSET 30")
add(
    "pg_completion",
    entries(lambda e: f.page(f.narrow_by_label(e, NORM), 2)),
    f"SELECT {ENTRY_SQL} FROM entries WHERE norm1 LIKE '%{NORM}%' ORDER BY label_length NULLS LAST, id LIMIT 15 OFFSET 15",
)
for name, run, cond in [
    ("op_completion_prefix", lambda e: f.narrow_by_label_prefix(e, "acute"), "norm1 LIKE '%acute%'"),
    ("op_completion_substring", lambda e: f.narrow_by_label(e, "fever"), "norm1 LIKE '%fever%'"),
    ("op_completion_mixed", lambda e: f.narrow_by_label_mixed(e, "gene"), "(norm1 LIKE 'gene%' OR norm1 LIKE '_%gene%')"),
]:
    add(name, entries(lambda e, r=run: f.page(r(e), 1)), f"SELECT {ENTRY_SQL} FROM entries WHERE {cond} ORDER BY label_length NULLS LAST, id LIMIT 15")
add(
    "pg_entries_index",
    entries(lambda e: f.page(e.orderBy(F.desc_nulls_first("mode"), F.asc_nulls_last("label"), "id"), 2)),
    f"SELECT {ENTRY_SQL} FROM entries ORDER BY mode DESC NULLS FIRST, label NULLS LAST, id LIMIT 15 OFFSET 15",
)
add(
    "pg_public_grid",
    lambda s, d: f.page(f.public(table(s, d, "dictionaries")).orderBy(F.desc("updated_at"), "id"), 1, 20).select("id", "name"),
    "SELECT id, name FROM dictionaries WHERE public ORDER BY updated_at DESC, id LIMIT 20",
)


def _worth(e: DataFrame) -> DataFrame:
    from termforge.functions.udfs import worth_embedding

    return e.where(worth_embedding(F.col("label"))).select("label").distinct()


def _result_hash(s: SparkSession, d: str) -> DataFrame:
    from termforge.operators.aggregates import tag_concat

    e = table(s, d, "entries").select("id", "label", "norm1", "norm2", "identifier")
    return e.join(tag_concat(e, table(s, d, "entry_tags"), table(s, d, "tags")), "id", "left")
