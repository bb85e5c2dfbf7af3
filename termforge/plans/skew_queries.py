"""Queries of problem 1: results per dictionary, in even time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.operators.skew import Part, keys_with_share, salted_aggregate
from termforge.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    counts = salted_aggregate(table(spark, d, "entries"), "dictionary_id", [Part("n", F.count(F.lit(1)))], salt_on="id")
    return keys_with_share(counts, "dictionary_id", "n", per_mille=45)


def p1_dictionary_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, exact distinct labels, modes and label lengths of every dictionary; salted on label so that the distinct count adds up."""
    parts = [
        Part("n_rows", F.count(F.lit(1))),
        Part("n_labels", F.count_distinct("label")),
        Part("n_black", F.count_if(F.col("mode") == 2)),
        Part("n_searchable", F.count_if("searchable")),
        Part("sum_length", F.sum(F.length("label").cast("long"))),
        Part("min_id", F.min("id"), "min"),
        Part("max_id", F.max("id"), "max"),
    ]
    return salted_aggregate(table(spark, d, "entries"), "dictionary_id", parts, salt_on="label")


QUERIES = {"p1_found": p1_found, "p1_dictionary_profile": p1_dictionary_profile}
ORACLE = {
    "p1_found": """SELECT dictionary_id FROM entries WHERE dictionary_id IS NOT NULL GROUP BY dictionary_id
        HAVING count(*) * 1000 >= (SELECT count(*) FROM entries) * 45""",
    "p1_dictionary_profile": """SELECT dictionary_id, count(*) AS n_rows, count(DISTINCT label) AS n_labels,
        count(*) FILTER (mode = 2) AS n_black, count(*) FILTER (searchable) AS n_searchable,
        CAST(sum(length(label)) AS BIGINT) AS sum_length, min(id) AS min_id, max(id) AS max_id
        FROM entries GROUP BY dictionary_id""",
}
