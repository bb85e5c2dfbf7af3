"""Queries of the llm subpackage and the SQL that they are held against."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import copies, encode, garble, lookalike, mixing, neighbours, term_counts
from termforge.sources.tables import table

LABEL_COMMON, WORD_COMMON, RARE_BELOW = 0.01, 0.5, 3


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    entries, dictionaries = table(spark, d, "entries"), table(spark, d, "dictionaries")
    labels = term_counts.marked(
        term_counts.term_counts(entries, F.col("label")), entries.agg(F.count("label")).scalar(), RARE_BELOW, LABEL_COMMON
    )
    words = term_counts.marked(
        term_counts.term_counts(dictionaries, F.col("no_term_words")), dictionaries.agg(F.count("no_term_words")).scalar(), RARE_BELOW, WORD_COMMON
    )
    return labels.withColumn("field", F.lit("label")).unionByName(words.withColumn("field", F.lit("no_term_words")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("mark IS NOT NULL").select("field", "term", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, d, "entries"), "id", ["label", "norm1", "norm2"], ["dictionary_id", "identifier"])


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The links of p3_found in one row per value: its class and how many rows it is linked to."""
    found = lookalike.alike_members(table(spark, d, "entries"), "id", ["label", "norm1", "norm2"], ["dictionary_id", "identifier"])
    return found.select("id", "field", "class_id", "n_links")


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every entry's label with the one form that stands for it within its dictionary and identifier."""
    rows = table(spark, d, "entries").select("id", "dictionary_id", "identifier", "label")
    return lookalike.with_consistent(rows, "label", ["dictionary_id", "identifier"]).select("id", "label", "canonical")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every entry's label, norm1 and norm2 with the one form of all values that look the same, whatever their entry and field."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("label", "norm1", "norm2")])
    return lookalike.with_one_form(table(spark, d, "entries").select("id", F.inline(fields)), "value")


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return copies.ledger_of(table(spark, d, "entries"), "id", ["dictionary_id"], ["label", "identifier"], at="created_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(*_ledger(spark, d))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: its earliest entry and its number of copies."""
    return _ledger(spark, d)[1].select("first_id", "copies")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").select("id", "embedding").unionByName(table(spark, d, "semantic_dict_16").select("id", "embedding"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar others of every usable vector of both tables, however far they are."""
    return neighbours.neighbours(_vectors(spark, d), "id", "embedding", least=None)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.neighbours(_vectors(spark, d), "id", "embedding", least=0.82)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix(mixing.sized_documents(table(spark, d, "documents"), targets), targets)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(*mixing.mix(mixing.sized_documents(table(spark, d, "documents"), targets), targets))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.garbled(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id").distinct()


QUERIES = {
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_members": p3_members,
    "p3_consistent": p3_consistent,
    "p3_forms": p3_forms,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}


def _q(s: str) -> str:
    """A DuckDB string of any characters."""
    runs = [(shown, "".join(cs)) for shown, cs in groupby(s, lambda c: c.isprintable() and c != "'")]
    parts = [p for shown, run in runs for p in ([f"'{run}'"] if shown else [f"chr({ord(c)})" for c in run])]
    return f"array_to_string([{', '.join(parts)}], '')" if parts else "''"


def _spelled_sql(c: str) -> str:
    for a, b in lookalike.several_map().items():
        c = f"replace({c}, {_q(a)}, '{b}')"
    return c


def _mapped_sql(c: str) -> str:
    src, dst = lookalike.alike_map()
    c = _spelled_sql(c)
    gone = f"translate({c}, {_q(src[len(dst) :])}, '')"
    return f"translate({gone}, {_q(src[: len(dst)])}, {_q(dst)})"


def _alike_sql(c: str) -> str:
    return f"nfc_normalize({_mapped_sql(c)})"


def _tidy_sql(c: str) -> str:
    src, dst = lookalike.tidy_map()
    c = _spelled_sql(c)
    gone = f"translate({c}, {_q(src[len(dst) :])}, '')"
    return f"nfc_normalize(translate({gone}, {_q(src[: len(dst)])}, {_q(dst)}))"


_TERMS = """WITH t AS (
    SELECT 'label' AS field, id, unnest(string_split(label, ' ')) AS term FROM entries
    UNION ALL SELECT 'no_term_words', id, unnest(no_term_words) FROM dictionaries),
  n AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t
    WHERE term IS NOT NULL AND NOT (field = 'label' AND term = '') GROUP BY field, term),
  m AS (SELECT field, term, occurrences, records, CASE WHEN occurrences < 3 THEN 'rare'
    WHEN field = 'label' AND records > 0.01 * (SELECT count(label) FROM entries) THEN 'common'
    WHEN field = 'no_term_words' AND records > 0.5 * (SELECT count(no_term_words) FROM dictionaries) THEN 'common' END AS mark FROM n) """
_BARE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')"
_COPIES = f"""WITH b AS (SELECT id, dictionary_id, {_BARE.format(_alike_sql("label"))} AS a, {_BARE.format(_alike_sql("identifier"))} AS b
    FROM entries WHERE dictionary_id IS NOT NULL AND label IS NOT NULL AND identifier IS NOT NULL),
  g AS (SELECT id, dictionary_id, least(a, b) AS lo, greatest(a, b) AS hi FROM b),
  c AS (SELECT dictionary_id, lo, hi, min(id) AS first_id, count(*) AS copies FROM g GROUP BY dictionary_id, lo, hi) """

ORACLE = {
    "p2_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT field, term, occurrences, records, mark FROM m",
    "p3_found": f"""WITH r AS (SELECT id, dictionary_id, identifier, unnest(['label', 'norm1', 'norm2']) AS field, unnest([label, norm1, norm2]) AS v
        FROM entries WHERE dictionary_id IS NOT NULL AND identifier IS NOT NULL),
      k AS (SELECT id, dictionary_id, identifier, field, v, {_alike_sql("v")} AS look FROM r WHERE v IS NOT NULL)
      SELECT DISTINCT a.id AS id_a, b.id AS id_b, field FROM k a JOIN k b USING (dictionary_id, identifier, field, look)
      WHERE a.id < b.id AND a.v <> b.v""",
    "p3_members": f"""WITH r AS (SELECT id, dictionary_id, identifier, unnest(['label', 'norm1', 'norm2']) AS field, unnest([label, norm1, norm2]) AS v
        FROM entries WHERE dictionary_id IS NOT NULL AND identifier IS NOT NULL),
      k AS (SELECT id, dictionary_id, identifier, field, v, {_alike_sql("v")} AS look FROM r WHERE v IS NOT NULL),
      n AS (SELECT id, field, min(id) OVER c AS class_id, count(*) OVER c - count(*) OVER (PARTITION BY dictionary_id, identifier, field, look, v) AS n_links FROM k
        WINDOW c AS (PARTITION BY dictionary_id, identifier, field, look))
      SELECT id, field, class_id, n_links FROM n WHERE n_links > 0""",
    "p3_consistent": f"""WITH e AS (SELECT id, dictionary_id, identifier, label, {_alike_sql("label")} AS look, label <> {_mapped_sql("label")} AS changed FROM entries),
      c AS (SELECT dictionary_id, identifier, look, min({{changed: changed, n: length(label), v: label}}).v AS v FROM e
        WHERE dictionary_id IS NOT NULL AND identifier IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2, 3)
      SELECT id, label, coalesce(v, label) AS canonical FROM e LEFT JOIN c USING (dictionary_id, identifier, look)""",
    "p3_forms": f"""WITH r AS (SELECT id, unnest(['label', 'norm1', 'norm2']) AS field, unnest([label, norm1, norm2]) AS value FROM entries),
      k AS (SELECT id, field, value, {_alike_sql("value")} AS look, value <> {_mapped_sql("value")} AS changed FROM r),
      c AS (SELECT look, min({{changed: changed, n: length(value), v: value}}).v AS v FROM k WHERE value IS NOT NULL GROUP BY look)
      SELECT id, field, value, {_tidy_sql("v")} AS canonical FROM k LEFT JOIN c USING (look)""",
    "p4_found": _COPIES + "SELECT first_id, id AS copy_id FROM g JOIN c USING (dictionary_id, lo, hi) WHERE id <> first_id",
    "p4_records": _COPIES + "SELECT first_id, copies FROM c",
}
