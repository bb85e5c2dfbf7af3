"""Occurrences and records of every distinct term, by last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL = "term string, occurrences long, records long"


class LastSeen:
    """Counters of occurrences, records and last record per term, fed with tokens in record order; no set of records is kept."""

    def __init__(self) -> None:
        self.slot: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)

    def add(self, terms: list[str], code: np.ndarray, record: np.ndarray) -> None:
        """Tokens of whole records: code points into terms, record never falls."""
        at = np.fromiter((self.slot.setdefault(t, len(self.slot)) for t in terms), np.int64, len(terms))
        while len(self.slot) > len(self.last):
            self.occurrences, self.records = (np.concatenate([a, np.zeros_like(a)]) for a in (self.occurrences, self.records))
            self.last = np.concatenate([self.last, np.full_like(self.last, -1)])
        slot = at[code]
        order = np.argsort(slot, kind="stable")
        slot, record = slot[order], record[order]
        head = np.ones(len(slot), bool)
        head[1:] = slot[1:] != slot[:-1]
        before = np.empty_like(record)
        before[1:] = record[:-1]
        before[head] = self.last[slot[head]]
        self.occurrences += np.bincount(slot, minlength=len(self.last))
        self.records += np.bincount(slot[record != before], minlength=len(self.last))
        tail = np.append(head[1:], True)[: len(slot)]
        self.last[slot[tail]] = record[tail]

    def flush(self) -> pa.RecordBatch:
        n = len(self.slot)
        batch = pa.record_batch(
            {"term": pa.array(list(self.slot), pa.string()), "occurrences": self.occurrences[:n].copy(), "records": self.records[:n].copy()}
        )
        self.__init__()
        return batch


def _counter(max_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, base = LastSeen(), 0
        for b in batches:
            tokens = b.column(0)
            if pa.types.is_string(tokens.type) or pa.types.is_large_string(tokens.type):
                tokens = pc.split_pattern(tokens, " ")
                split = True
            else:
                split = False
            flat, record = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
            keep = pc.is_valid(flat)
            if split:
                keep = pc.and_(keep, pc.not_equal(flat, ""))
            flat, record = flat.filter(keep), np.asarray(record.filter(keep), np.int64)
            coded = flat.dictionary_encode()
            if len(flat):
                seen.add(coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64), record + base)
            base += b.num_rows
            if len(seen.slot) > max_terms:
                yield seen.flush()
        if seen.slot:
            yield seen.flush()

    return run


def term_counts(df: DataFrame, tokens: Column, max_terms: int = 200_000) -> DataFrame:
    """(term, occurrences, records) of every distinct term in `tokens`, over all rows of df.

    `tokens` is a string, whose terms are its non-empty pieces between U+0020 spaces, or an array of strings, whose terms are its
    elements (the empty string too). A row is a record. Terms are compared byte by byte as stored.

    Each task feeds its records in order to last-seen counters, so that a term's records are counted without a set per record
    or per term, and emits its counters at the end, or when they hold more than max_terms terms (between records, so no record is
    split). The partial counters are then hash-partitioned by term and added up: a term that occurs in every row
    arrives as a few partials per task, and so doesn't make its partition hot.

    Null strings, null arrays and null elements hold no term; a table without terms gives no rows. Repeats within a record raise
    occurrences but not records; repeated rows are records of their own. Other columns of df don't matter.
    """
    partial = df.select(tokens.alias("tokens")).mapInArrow(_counter(max_terms), PARTIAL)
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, records: Column, rare_below: int = 3, common_above: float = 0.01) -> DataFrame:
    """Adds mark: `rare` below rare_below occurrences, `common` in more than common_above of all records, else null."""
    share = F.lit(Decimal(str(common_above)))  # exact, so that a term at the very border isn't misjudged
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > records * share, "common")
    return counts.withColumn("mark", mark)
