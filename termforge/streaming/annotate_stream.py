"""Annotating documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from termforge.operators.annotate import Options, annotate, compiled_entries
from termforge.session import written


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def annotate_stream(
    docs: DataFrame, entries: DataFrame, dictionaries: DataFrame, out: str, checkpoint: str, options: Options | None = None
) -> StreamingQuery:
    """Annotates each batch of new documents and appends the results under `batch=<n>`; a batch that is run again replaces its own folder.

    The dictionaries are compiled once, when the stream starts, and serve all its batches.
    """
    compiled = written(compiled_entries(entries, dictionaries), "compiled")

    def run(batch: DataFrame, number: int) -> None:
        annotate(batch, entries, dictionaries, options, compiled=compiled).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
