"""Sources and sinks on files made of the given tables, and steps of the annotator as queries of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions.udfs import normalize1, normalize2, tokenize
from termforge.operators import dictionary_jobs
from termforge.operators.annotate import Options, candidate_occurrences, compiled_entries, span_rules, surface_matches
from termforge.plans import aggregate_queries
from termforge.plans.annotate_queries import docs, public
from termforge.plans.lookup_queries import _TRI
from termforge.session import new_path
from termforge.sources import entry_file, export
from termforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def lines_of(s: SparkSession, d: str) -> DataFrame:
    """A line for every entry, in the forms that loaders meet: most with tabs, some as CSV, some with a fault, told by the id."""
    flat = lambda c: F.translate(F.coalesce(c, F.lit("")), "\t\r\n", "   ")
    e = table(s, d, "entries").select("id", flat("label").alias("l"), flat("identifier").alias("i"), (F.col("id") % 40).alias("k"))
    tags = F.concat(F.lit("t"), (F.col("id") % 7).cast("string"), F.lit(",u"))
    tabbed = lambda *c: F.concat_ws("\t", *c)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    forms = [
        F.concat(F.lit("# line "), F.col("id").cast("string")), F.concat(F.lit("lonely"), F.col("id").cast("string")), F.concat_ws(",", *[quoted(c) for c in (F.col("l"), F.col("i"), tags)]),
        tabbed(F.rpad("l", 200, "x"), "i", tags), tabbed("l", F.rpad("i", 300, "y"), tags), tabbed("l", "i", tags, F.lit("x"), F.lit("y")), F.lit("  "),
    ]
    line = F.when(F.trim("l", F.lit(" \x0b\x0c")) == "", F.lit("#"))
    for k, form in enumerate(forms):
        line = line.when(F.col("k") == k, form)
    return e.select(line.otherwise(tabbed("l", "i", tags)).alias("line"))


def written_file(s: SparkSession, d: str) -> str:
    """These lines as files, one per task."""
    path = new_path(s, "entry-file")
    lines_of(s, d).write.text(path)
    return path


_LINES = """WITH c AS (SELECT id % 40 AS k, translate(coalesce(label, ''), chr(9) || chr(13) || chr(10), '   ') AS l, translate(coalesce(identifier, ''), chr(9) || chr(13) || chr(10), '   ') AS identifier,
    't' || id % 7 || ',u' AS tags FROM entries),
  n AS (SELECT *, CASE WHEN k = 2 THEN l ELSE ltrim(l, ' ' || chr(11) || chr(12)) END AS label FROM c WHERE trim(l, ' ' || chr(11) || chr(12)) <> '' AND k NOT IN (0, 6)),
  r AS (SELECT label, identifier, tags, CASE WHEN k <> 2 AND starts_with(label, '#') AND k <> 1 THEN 'skip' WHEN k = 1 THEN 'too few items' WHEN length(label) < 2 OR length(label) > 127 OR k = 3 THEN 'label length'
    WHEN identifier = '' AND k <> 4 OR length(identifier) > 255 OR k = 4 THEN 'identifier length' END AS reason FROM n),
  g AS (SELECT label, identifier, tags FROM r WHERE reason IS NULL)"""
add("src_entry_file", lambda s, d: entry_file.read_entries(s, written_file(s, d)).entries.select("label", "identifier"), f"{_LINES} SELECT label, identifier FROM g")
add("src_tags_parse", lambda s, d: entry_file.read_entries(s, written_file(s, d)).entries.select("identifier", F.explode("tags").alias("tag")), f"{_LINES} SELECT identifier, unnest(string_split(tags, ',')) AS tag FROM g")
add(
    "src_rejected_lines",
    lambda s, d: entry_file.read_entries(s, written_file(s, d)).rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    f"{_LINES} SELECT reason, count(*) AS n FROM r WHERE reason <> 'skip' GROUP BY 1",
)


def load_job(s: SparkSession, d: str) -> DataFrame:
    """All these lines loaded into dictionary 31, emptied before; what came in, and the figures of the report."""
    e = table(s, d, "entries").where("dictionary_id <> 31 OR dictionary_id IS NULL")
    out = dictionary_jobs.load(s, written_file(s, d), e, table(s, d, "tags"), 31)
    figures = out.report.withColumn("n_reported", out.skipped.agg(F.count(F.lit(1))).scalar()).withColumn("n_tagged", out.entry_tags.agg(F.count(F.lit(1))).scalar())
    stacked = figures.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.lit("").alias("identifier"), F.col(c).cast("long").alias("n")) for c in figures.columns])))
    return out.entries.select("label", "identifier", F.col("label_length").cast("long").alias("n")).unionByName(stacked)


add(
    "src_load_job",
    load_job,
    f"""{_LINES}, e AS (SELECT DISTINCT label, identifier, length(label) AS n FROM g), f AS (SELECT (SELECT count(*) FROM entries) AS n_lines, (SELECT count(*) FROM e) AS n_entries,
    (SELECT count(*) FROM r WHERE reason <> 'skip') AS n_skipped, (SELECT least(100, count(*)) FROM r WHERE reason <> 'skip') AS n_reported, (SELECT 2 * count(*) FROM e) AS n_tagged)
    SELECT label, identifier, n FROM e UNION ALL SELECT label, '', n FROM (UNPIVOT f ON n_lines, n_entries, n_skipped, n_reported, n_tagged INTO NAME label VALUE n)""",
)
add(
    "src_skip_bad",
    lambda s, d: entry_file.read_entries(s, written_file(s, d), max_tokens=3).rejected.where("reason = 'token_limit'").groupBy().agg(F.count(F.lit(1)).alias("n")),
    rf"{_LINES} SELECT count(*) AS n FROM g WHERE len(regexp_split_to_array(label, '[ \t\n\x0b\f\r]+')) > 3",
)
add("src_batch_norm", lambda s, d: table(s, d, "entries").where("label IS NOT NULL").select("label").distinct().select("label", normalize1("label").alias("norm1"), normalize2("label").alias("norm2")))


def json_texts(s: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON objects and read back as annotation targets."""
    path = new_path(s, "texts-json")
    docs(s, d).where("text IS NOT NULL").select("text").write.json(path)
    texts = entry_file.texts_from_json(s, path, lines=True)
    return texts.groupBy().agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_distinct("doc_id").alias("n_ids"), F.max("doc_id").alias("last_id"))


add("src_http_text", json_texts, "SELECT count(text) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(text) AS n_ids, count(text) AS last_id FROM documents")


def tsv_folder(s: SparkSession, d: str) -> DataFrame:
    """The export written by all tasks and read back."""
    path = new_path(s, "tsv")
    header, lines = export.entry_lines(table(s, d, "entries"), table(s, d, "entry_tags"), table(s, d, "tags"))
    export.write_lines(header, lines, path)
    back = s.read.schema("label string, identifier string, tags string").csv(path, sep="\t", quote='"', escape='"', multiLine=True, encoding="UTF-8")
    return back.select("label", "identifier")


add("snk_tsv_files", tsv_folder, "SELECT nullif(label, '') AS label, nullif(identifier, '') AS identifier FROM entries UNION ALL SELECT '#label', 'id'")


def json_results(s: SparkSession, d: str) -> DataFrame:
    from termforge.operators.annotate import annotate

    folder = new_path(s, "results")
    export.write_results(annotate(docs(s, d), table(s, d, "entries"), public(s, d), Options(threshold=1.0)), folder, "job")
    back = s.read.schema("doc_id long, denotations array<struct<begin:int,end:int,obj:string>>").json(export.result_path(folder, "job"))
    return back.select("doc_id", F.inline("denotations"))


add("snk_json_result", json_results)


def zipped(s: SparkSession, d: str) -> DataFrame:
    """The export of all modes as a ZIP, and what it holds."""
    import csv
    import io
    import zipfile

    folder = new_path(s, "zip").removeprefix("file://")
    header, lines = export.entry_lines(table(s, d, "entries"), table(s, d, "entry_tags"), table(s, d, "tags"))
    with zipfile.ZipFile(export.write_zip("all entries", header, lines, folder)) as z:
        name = z.namelist()[0]
        with z.open(name) as f:
            n = sum(1 for _ in csv.reader(io.TextIOWrapper(f, "utf-8", newline=""), delimiter="\t"))
            return s.createDataFrame([(name, n)], "name string, n_lines long")


add("snk_zip", zipped, "SELECT 'all_entries.csv' AS name, count(*) + 1 AS n_lines FROM entries")


def compiled(part: str):
    """What compiling stores, read back."""

    def run(s: SparkSession, d: str) -> DataFrame:
        out = dictionary_jobs.compile_dictionaries(table(s, d, "entries"))
        if part == "postings":
            return out.postings
        lists = [F.array_join(c, " ").alias(c) for c in ("no_term_words", "no_begin_words", "no_end_words")]
        return out.stop_words.select("dictionary_id", *lists)

    return run


add(
    "op_compile_index",
    compiled("postings"),
    f"""SELECT dictionary_id, norm2, CAST(len(g) AS INTEGER) AS n_grams, unnest(g) AS gram FROM (SELECT dictionary_id, norm2, list_distinct({_TRI.format("norm2")}) AS g
    FROM (SELECT DISTINCT dictionary_id, norm2 FROM entries WHERE mode IN (0, 1) AND dictionary_id IS NOT NULL AND length(norm2) > 0))""",
)
add("op_compile_stop_words", compiled("stop_words"), aggregate_queries.ORACLE["agg_stopword_usage"])


# Steps of the annotator.
def paren_levels(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.inline(tokenize("text"))).where("level > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("deepest"))


def stopped_tokens(s: SparkSession, d: str) -> DataFrame:
    """Tokens whose norm2 is empty, as they keep their place."""
    return docs(s, d).select("doc_id", F.inline(tokenize("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("norm2") == "").alias("n_stopped"))


def norm2_and_exact(s: SparkSession, d: str) -> DataFrame:
    """How many spans each dictionary's threshold lets through."""
    known = compiled_entries(table(s, d, "entries"), public(s, d))
    spans = candidate_occurrences(docs(s, d), span_rules(public(s, d), Options()), known).select("span", "norm1", "norm2").distinct()
    return surface_matches(spans, known, Options()).groupBy("dictionary_id").agg(F.count_distinct("span").alias("n_spans"))


add("fn_paren_level", paren_levels)
add("fn_norm2_align", stopped_tokens)
add("ann_matches_by_dictionary", norm2_and_exact)
