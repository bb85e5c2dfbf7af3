"""Files of dictionary entries: tab-separated or CSV, decided line by line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.functions.udfs import norms

MAX_LABEL, MAX_IDENTIFIER, MAX_TOKENS = 127, 255, 10_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines of each file numbered from 1 in their order, however many tasks read the file.

    Lines are counted per split of a file first; a line's number is what the splits before its own hold and its place within.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line")
    )
    splits = lines.groupBy("file", "block").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("m") - F.col("first") + 1).alias("line_no"), "line")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Adds label, identifier, tag_text and reason; reason is null for a good line, `skip` for blank and comment lines."""
    line = F.trim("line", F.lit(" \t\r\n\x0b\x0c"))
    csv = F.from_csv(line, "a string, b string, c string, d string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "quote": '"', "escape": '"', "nullValue": "\x01", "emptyValue": ""})
    tabs = F.split(line, "\t")
    given = lines.withColumn("t", tabs).withColumn("c", csv).withColumn("is_tab", line.contains("\t"))
    item = lambda i, name: F.when(F.col("is_tab"), F.try_element_at("t", F.lit(i))).otherwise(F.col(f"c.{name}"))
    one, two, three = item(1, "a"), item(2, "b"), item(3, "c")
    reason = (
        F.when((line == "") | line.startswith("#"), "skip")
        .when(two.isNull(), "too few items")
        .when((F.coalesce(F.length(one), F.lit(0)) < 2) | (F.length(one) > MAX_LABEL), "label length")
        .when((two == "") | (F.length(two) > MAX_IDENTIFIER), "identifier length")
    )
    return given.select("file", "line_no", "line", one.alias("label"), two.alias("identifier"), three.alias("tag_text"), reason.alias("reason"))


def parsed_tags(text: Column) -> Column:
    """Tags of a comma-joined list; an empty or null text, or a quoted empty one, has none; any other form stops the load."""
    plain = F.coalesce(text, F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("invalid tags: "), plain)).cast("array<string>")
    return (
        F.when((plain == "") | (plain == '""'), F.array().cast("array<string>")).when(plain.rlike(r"^([a-zA-Z0-9]+)(,[a-zA-Z0-9]+)*$"), F.split(plain, ",")).otherwise(wrong)
    )


@dataclass(frozen=True)
class Load:
    entries: DataFrame  # file, line_no, label, identifier, tags, norm1, norm2
    rejected: DataFrame  # file, line_no, line, reason


def read_entries(spark: SparkSession, path: str, max_tokens: int = MAX_TOKENS) -> Load:
    """Entries of a file and its rejected lines. Labels of more than max_tokens words are rejected with the reason token_limit."""
    rows = parsed_lines(numbered_lines(spark, path))
    long = F.size(F.split("label", r"\s+")) > max_tokens
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(long, "token_limit")))
    good = rows.where("reason IS NULL").select(
        "file", "line_no", "label", "identifier", parsed_tags(F.col("tag_text")).alias("tags"), norms("label").alias("n")
    )
    return Load(good.select("*", "n.*").drop("n"), rows.where("reason <> 'skip'").select("file", "line_no", "line", "reason"))


def require_empty(entries: DataFrame, dictionary_id: int) -> None:
    if not entries.where((F.col("dictionary_id") == dictionary_id) & (F.col("mode") != 2)).isEmpty():
        raise ValueError("entries can be loaded into an empty dictionary only")


def _place() -> list[Column]:
    meta = F.col("_metadata")
    return [meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("m")]


def texts_from_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc_id, text) from files of a JSON object or array with `text`, or with one object a line, numbered from 1 in their order.

    A file of an object or array is read whole by one task, one of lines in splits; numbers come from counts per split, so no task sees all texts.
    """
    rows = spark.read.schema("text string").json(path, multiLine=not lines)
    return _in_order(rows.select(*_place(), "text"))


def text_from_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): plain files, one text each, numbered from 1 in the order of their names."""
    rows = spark.read.text(path, wholetext=True)
    return _in_order(rows.select(*_place(), F.col("value").alias("text")))


def _in_order(rows: DataFrame) -> DataFrame:
    splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.join(starts, ["file", "block"])
    return placed.select((F.col("start") + F.col("m") - F.col("first") + 1).alias("doc_id"), "text")
