"""Counts, collections, jobs and exports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions.stopwords import EDGE_WORDS, NO_TERM_WORDS
from termforge.operators import aggregates as a
from termforge.operators import jobs as j
from termforge.plans.filter_queries import PATTERNS_SQL, patterns
from termforge.sources import export
from termforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = "2025-01-02 00:00:00"


def add(name, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def of(name: str, run):
    return lambda s, d: run(table(s, d, name))


def now():
    return F.lit(NOW).cast("timestamp_ntz")


add("agg_entries_num", of("entries", a.entries_num), "SELECT dictionary_id, count(*) FILTER (mode <> 2) AS entries_num FROM entries GROUP BY 1")
add(
    "agg_mode_counts",
    of("entries", a.mode_counts),
    """SELECT dictionary_id, count(*) FILTER (mode = 0) AS num_gray, count(*) FILTER (mode = 1) AS num_white, count(*) FILTER (mode = 2) AS num_black,
    count(*) FILTER (mode = 6) AS num_auto_expanded FROM entries GROUP BY 1""",
)
add("agg_distinct_identifiers", of("entries", a.distinct_identifiers), "SELECT dictionary_id, count(DISTINCT identifier) AS n_identifiers FROM entries WHERE mode IN (0, 1) GROUP BY 1")
add("agg_distinct_norm2", of("entries", a.distinct_norm2), "SELECT DISTINCT dictionary_id, norm2 FROM entries WHERE mode IN (0, 1) AND norm2 IS NOT NULL")


def coverage(s: SparkSession, d: str) -> DataFrame:
    semantic = table(s, d, "semantic_dict_16").select("id").distinct().withColumn("has", F.lit(True))
    e = table(s, d, "entries").join(semantic, "id", "left")
    return a.embedding_coverage(e, F.col("embedding").isNotNull() | F.coalesce("has", F.lit(False)))


add(
    "agg_embedding_coverage",
    coverage,
    """WITH c AS (SELECT dictionary_id, count(*) AS total, count(*) FILTER (embedding IS NOT NULL OR id IN (SELECT id FROM semantic_dict_16)) AS w FROM entries GROUP BY 1)
    SELECT dictionary_id, total, w AS with_embedding, total - w AS without_embedding, round(w / total * 100, 2) AS coverage FROM c""",
)
add("agg_cluster_size", of("entries", lambda e: a.cluster_sizes(e, 3)), "SELECT identifier, count(*) AS n FROM entries WHERE identifier IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
add(
    "agg_embed_summary",
    of("semantic_dict_16", a.embed_summary),
    """WITH c AS (SELECT dictionary_id, count(embedding) AS n, count(*) FILTER (embedding IS NOT NULL AND searchable) AS s, count(*) AS t FROM semantic_dict_16 GROUP BY 1)
    SELECT dictionary_id, n AS total_with_embeddings, s AS searchable, n - s AS non_searchable, round(s / n * 100, 2) AS searchable_percent,
    round((n - s) / n * 100, 2) AS non_searchable_percent, round(n / t * 100, 2) AS success_rate FROM c""",
)
add(
    "agg_group_labels",
    lambda s, d: a.labels_by_identifier(table(s, d, "entries").where("label IS NOT NULL"), table(s, d, "dictionaries")).select(
        "identifier", F.array_join(F.transform("labels", lambda x: F.concat(x["label"], F.lit("@"), x["dictionary"])), "|").alias("labels")
    ),
    """SELECT identifier, string_agg(label || '@' || name, '|' ORDER BY label, name) AS labels FROM entries e JOIN dictionaries d ON d.id = e.dictionary_id
    WHERE identifier IS NOT NULL AND label IS NOT NULL GROUP BY 1""",
)
_TAGLIST = """SELECT entry_id AS id, string_agg(value, ',' ORDER BY tag_id) AS tags FROM (SELECT DISTINCT entry_id, tag_id FROM entry_tags) x
    JOIN (SELECT id AS tag_id, value FROM tags) t USING (tag_id) WHERE entry_id IN (SELECT id FROM entries) GROUP BY entry_id"""
add("agg_tag_concat", lambda s, d: a.tag_concat(table(s, d, "entries"), table(s, d, "entry_tags"), table(s, d, "tags")), _TAGLIST)
add(
    "join_tags_bridge",
    lambda s, d: table(s, d, "entries").select("id", "label").join(table(s, d, "entry_tags"), F.col("id") == F.col("entry_id")).join(table(s, d, "tags").select(F.col("id").alias("tag_id"), "value"), "tag_id").select("id", "label", "value"),
    "SELECT e.id, label, value FROM entries e JOIN entry_tags x ON x.entry_id = e.id JOIN tags t ON t.id = x.tag_id",
)


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


add(
    "agg_stopword_usage",
    of("entries", lambda e: a.stopword_lists(e, NO_TERM_WORDS, EDGE_WORDS, EDGE_WORDS).select("dictionary_id", *[F.array_join(c, " ").alias(c) for c in ("no_term_words", "no_begin_words", "no_end_words")])),
    rf"""WITH t AS (SELECT dictionary_id, regexp_split_to_array(trim(lower(label), ' ' || chr(9) || chr(10)), '[\s]+') AS t FROM entries WHERE dictionary_id IS NOT NULL),
    u AS (SELECT dictionary_id, list(DISTINCT w) AS used FROM (SELECT dictionary_id, unnest(t) AS w FROM t) GROUP BY 1),
    f AS (SELECT dictionary_id, list(DISTINCT t[1]) AS first, list(DISTINCT t[-1]) AS last FROM t GROUP BY 1),
    x AS (SELECT f.*, coalesce(used, []) AS used FROM f LEFT JOIN u ON f.dictionary_id IS NOT DISTINCT FROM u.dictionary_id)
    SELECT dictionary_id, array_to_string(list_filter({_list_sql(list(dict.fromkeys(NO_TERM_WORDS)))}, lambda w: NOT list_contains(used, w)), ' ') AS no_term_words,
    array_to_string(list_filter({_list_sql(list(dict.fromkeys(EDGE_WORDS)))}, lambda w: NOT list_contains(first, w)), ' ') AS no_begin_words,
    array_to_string(list_filter({_list_sql(list(dict.fromkeys(EDGE_WORDS)))}, lambda w: NOT list_contains(last, w)), ' ') AS no_end_words FROM x""",
)

_STATUS = "CASE WHEN length(message) > 0 THEN 'error' WHEN ended_at IS NOT NULL THEN 'done' WHEN begun_at IS NOT NULL THEN 'in_progress' ELSE 'in_queue' END"
_LATEST = """(SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ended_at DESC NULLS LAST, num_dones DESC NULLS LAST, begun_at DESC NULLS LAST,
    registered_at DESC NULLS LAST, message DESC NULLS LAST, metadata DESC NULLS LAST) AS r FROM jobs) WHERE r = 1)"""
add("prj_job_status", lambda s, d: j.latest(table(s, d, "jobs")).select("id", j.status().alias("status")), f"SELECT id, {_STATUS} AS status FROM {_LATEST}")
for name, run, cond in [
    ("flt_jobs_waiting", j.waiting, "begun_at IS NULL"),
    ("flt_jobs_running", j.running, "begun_at IS NOT NULL AND ended_at IS NULL"),
    ("flt_jobs_unfinished", j.unfinished, "ended_at IS NULL"),
    ("flt_jobs_finished", j.finished, "ended_at IS NOT NULL"),
]:
    add(name, lambda s, d, r=run: r(j.latest(table(s, d, "jobs"))).select("id", "name"), f"SELECT id, name FROM {_LATEST} WHERE {cond}")
add("agg_job_queue", lambda s, d: j.queue_totals(j.latest(table(s, d, "jobs"))), f"SELECT queue_name, CAST(coalesce(sum(time), 0) AS BIGINT) AS seconds, count(*) AS n_jobs FROM {_LATEST} WHERE begun_at IS NULL GROUP BY 1")
add(
    "fn_job_etr",
    lambda s, d: j.etr(j.latest(table(s, d, "jobs")), now()).select("id", "status", F.round("etr", 3).alias("etr")),
    f"""WITH l AS {_LATEST}, q AS (SELECT queue_name, coalesce(sum(time), 0) AS t FROM l WHERE begun_at IS NULL GROUP BY 1),
    x AS (SELECT id, {_STATUS} AS status, coalesce(t, 0) AS t, time, num_items, num_dones, epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(begun_at))::BIGINT AS e FROM l LEFT JOIN q USING (queue_name))
    SELECT id, status, round(CAST(CASE WHEN status = 'in_queue' THEN t / 4 + time WHEN status = 'in_progress' AND num_dones > 0 AND e <> 0 AND num_items IS NOT NULL
    THEN (num_items - num_dones) / ((num_dones / e) * 2) ELSE 5 END AS DOUBLE), 3) AS etr FROM x""",
)
add("flt_job_expired", lambda s, d: j.expired(j.latest(table(s, d, "jobs")), now()).select("id"), f"SELECT id FROM {_LATEST} WHERE name = 'Text annotation' AND ended_at < TIMESTAMP '{NOW}' - INTERVAL 1 DAY")
add(
    "fn_duration_words",
    lambda s, d: table(s, d, "jobs").select("time").distinct().select("time", j.duration_words(F.col("time") * 397).alias("words")),
    """SELECT DISTINCT time, concat_ws(' ', CASE WHEN t >= 86400 THEN (t // 86400) || 'd' END, CASE WHEN t >= 3600 THEN (t // 3600 % 24) || 'h' END,
    CASE WHEN t >= 60 THEN (t // 60 % 60) || 'm' END, (t % 60) || 's') AS words FROM (SELECT time, time * 397 AS t FROM jobs)""",
)
add("fn_time_estimate", lambda s, d: table(s, d, "documents").select("doc_id", j.time_estimate(F.length("text")).alias("seconds")), "SELECT doc_id, CAST(1.0 + length(text) * 0.00001 AS DOUBLE) AS seconds FROM documents")
add(
    "snk_job_csv",
    lambda s, d: j.description(j.latest(table(s, d, "jobs"))),
    f"""WITH l AS {_LATEST} SELECT id, key, value FROM (SELECT id, unnest(['status', 'name', 'dictionary_id', 'num_items', 'num_dones', 'queue_name', 'message']) AS key,
    unnest([{_STATUS}, name, CAST(dictionary_id AS VARCHAR), CAST(num_items AS VARCHAR), CAST(num_dones AS VARCHAR), queue_name, message]) AS value FROM l) WHERE value IS NOT NULL""",
)
add(
    "op_last_embedding_job",
    lambda s, d: j.last_completed(j.latest(table(s, d, "jobs")), "Update embeddings").select("id", "dictionary_id"),
    f"SELECT id, dictionary_id FROM (SELECT *, row_number() OVER (PARTITION BY dictionary_id ORDER BY ended_at DESC, id) AS r FROM {_LATEST} WHERE ended_at IS NOT NULL AND name = 'Update embeddings') WHERE r = 1",
)

_CELL = "CASE WHEN regexp_matches(coalesce({0}, ''), '[\t\"\r\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE coalesce({0}, '') END"
_TSV = " || chr(9) || ".join(_CELL.format(c) for c in ("label", "identifier", "tags"))
lines = lambda op: lambda s, d: export.entry_lines(table(s, d, "entries"), table(s, d, "entry_tags"), table(s, d, "tags"), op)[1]
add("snk_tsv", lines(False), f"SELECT e.id, {_TSV} AS line FROM entries e LEFT JOIN ({_TAGLIST}) t ON t.id = e.id")
add(
    "snk_tsv_operator",
    lines(True),
    f"SELECT e.id, {_TSV} || chr(9) || CASE WHEN mode = 1 THEN '+' WHEN mode = 2 THEN '-' ELSE '' END AS line FROM entries e LEFT JOIN ({_TAGLIST}) t ON t.id = e.id",
)
add("snk_pattern_tsv", lambda s, d: export.pattern_lines(patterns(s, d))[1], f"SELECT id, expression || chr(9) || identifier AS line FROM {PATTERNS_SQL}")
add(
    "snk_index_json",
    lambda s, d: export.dictionary_index(table(s, d, "dictionaries"), table(s, d, "users")).select("id", "name", "description", "entries_num", "maintainer"),
    "SELECT d.id, name, description, entries_num, username AS maintainer FROM dictionaries d LEFT JOIN users u ON u.id = d.user_id WHERE public",
)
