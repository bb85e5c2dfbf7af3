"""Writing entries, patterns, results and jobs as text."""

from __future__ import annotations

import io
import json
import os
import tempfile
import time
import urllib.request
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.operators.aggregates import tag_concat


def tsv_cell(c: Column) -> Column:
    """A cell, quoted where it holds a tab, a quote or a line end; null is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[\t"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def operator() -> Column:
    return F.when(F.col("mode") == 1, "+").when(F.col("mode") == 2, "-").otherwise("")


def entry_lines(entries: DataFrame, entry_tags: DataFrame, tags: DataFrame, with_operator: bool = False) -> tuple[str, DataFrame]:
    """Header line and (id, line) rows. The column of tags is there if any entry has a tag."""
    tagged = tag_concat(entries, entry_tags, tags)
    any_tag = not tagged.isEmpty()
    rows = entries.join(tagged, "id", "left") if any_tag else entries
    cells = ["label", "identifier", *(["tags"] if any_tag else [])]
    line = [tsv_cell(F.col(c)) for c in cells] + ([operator()] if with_operator else [])
    header = ["#label", "id", *(["#tags"] if any_tag else []), *(["operator"] if with_operator else [])]
    return "\t".join(header), rows.select("id", F.concat_ws("\t", *line).alias("line"))


def pattern_lines(patterns: DataFrame) -> tuple[str, DataFrame]:
    return "#label\tid", patterns.select("id", F.concat_ws("\t", tsv_cell(F.col("expression")), tsv_cell(F.col("identifier"))).alias("line"))


def write_lines(header: str, lines: DataFrame, folder: str) -> None:
    """A folder of text files in the order of ids, the header as its own first file; any number of tasks write."""
    ordered = lines.orderBy("id").select("line")
    ordered.write.mode("overwrite").text(folder)
    spark = lines.sparkSession
    spark.createDataFrame([(header,)], "line string").coalesce(1).write.mode("append").text(folder)


def read_in_order(header: str, lines: DataFrame) -> Iterator[str]:
    """Lines one partition after another, for a file on the driver."""
    yield header + "\n"
    for r in lines.orderBy("id").select("line").toLocalIterator(prefetchPartitions=True):
        yield r.line + "\n"


def write_zip(name: str, header: str, lines: DataFrame, folder: str) -> str:
    """A ZIP with the entries of all modes, streamed through the driver; it appears under its name once it is whole.

    It is one file for one reader to download, on the driver's machine, so it suits one dictionary; write_lines() writes tables of any size.
    """
    base = "_".join(name.split())
    Path(folder).mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{base}.csv", "w", force_zip64=True) as out:
        with io.TextIOWrapper(out, "utf-8") as t:
            t.writelines(read_in_order(header, lines))
    path = f"{folder}/{base}.zip"
    os.replace(part, path)
    return path


def is_stale(path: str, updated_at: float) -> bool:
    return not os.path.exists(path) or updated_at > os.path.getmtime(path)


def result_path(folder: str, job: str) -> str:
    return f"{folder}/annotation-{job}.json"


def write_results(annotated: DataFrame, folder: str, job: str) -> None:
    annotated.orderBy("doc_id").write.mode("overwrite").json(result_path(folder, job))


def result_status(folder: str, job: str) -> str:
    path = Path(result_path(folder, job))
    if not path.exists():
        return "not_found"
    return "success" if (path / "_SUCCESS").exists() else "error"


def purge(folder: str, older_than: float = 86400, now: float | None = None) -> list[str]:
    """Removes results older than a day; returns their names."""
    import shutil

    limit, gone = (now or time.time()) - older_than, []
    for p in Path(folder).glob("annotation-*.json"):
        if p.stat().st_mtime < limit:
            shutil.rmtree(p) if p.is_dir() else p.unlink()
            gone.append(p.name)
    return sorted(gone)


def put_results(annotated: DataFrame, url: str) -> None:
    """Each partition puts its results, as a JSON array, to a callback address."""

    def send(rows) -> None:
        body = json.dumps([r.asDict(recursive=True) for r in rows]).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"}, method="PUT")
        urllib.request.urlopen(request, timeout=60).close()

    annotated.foreachPartition(send)


def dictionary_index(dictionaries: DataFrame, users: DataFrame) -> DataFrame:
    """Public dictionaries with their owner's name, newest first."""
    owners = users.select(F.col("id").alias("user_id"), F.col("username").alias("maintainer"))
    d = dictionaries.where("public").join(owners, "user_id", "left")
    return d.select("id", "name", "description", "entries_num", "created_at", "updated_at", "maintainer").orderBy(F.desc("created_at"), "id")


def first_identifier_line(found: DataFrame, labels: list[str]) -> str:
    """One CSV line with the first identifier of each asked label, in their order."""
    from termforge.operators.lookup import first_ids

    ids = {r.label: r.identifier for r in first_ids(found).collect()}
    return ",".join(ids.get(x, "") for x in labels)
