"""Copies that differ in format only, counted in a ledger that takes one batch after another."""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.lookalike import consistent
from termforge.session import drop_table, external_table, names_in, new_path, read_text, remove, write_new, written

KEYS = ["k1", "k2"]


def bare(c: Column) -> Column:
    """Letters and digits of the consistent form, without case: accents and raised digits stay, everything else goes."""
    return F.regexp_replace(F.translate(F.lower(consistent(c)), "ς", "σ"), r"[^\p{L}\p{M}\p{N}]", "")


def copy_keys(df: DataFrame, id_col: str, scope: list[str], fields: list[str], at: str | None = None) -> DataFrame:
    """(id, at, k1, k2): equal keys, of 128 bits, for rows that are copies.

    The key covers the scope columns as stored and the bare() fields in sorted order, so that fields which changed places give the same
    key. Rows with a null in a scope column or field have no key and are left out; a field without letters and digits
    counts as an empty one. Very long texts are hashed whole. `at` is carried along, null where no column is named.
    """
    arrived = F.lit(None).cast("timestamp_ntz") if at is None else F.col(at)
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*scope, *fields]))
    rows = rows.select(F.col(id_col).alias("id"), arrived.alias("at"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], F.array_sort(F.array(*[bare(F.col(f)) for f in fields])).alias("bare"))
    scoped = [f"s{i}" for i in range(len(scope))]
    return rows.select("id", "at", F.xxhash64(*scoped, "bare").alias("k1"), F.xxhash64(F.lit("second"), "bare", *scoped).alias("k2"))


ROW = "k1 long, k2 long, copies long, first_id long, bucket int"


class Ledger:
    """Counts and earliest member per key, kept in a folder in buckets by key; add() folds one batch in.

    Opening a folder that holds a ledger goes on with it, from whatever process. The ledger is a list of segments, bucketed Parquet files
    each of which stands for some of the buckets; a manifest names the segments and the batches taken so far. add() reads and writes the
    buckets that its batch touches and leaves the others where they are. The new manifest appears only once the new segment is whole, so
    a job that ends early has changed nothing and is run again, and a batch whose name is known counts once. Two writers at the same time
    end in an error for one of them. Segments that the newest two manifests don't name are removed.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.folder = folder or new_path(spark, "ledger")
        self.versions = sorted(int(n[9:-5]) for n in names_in(spark, self.folder) if n.startswith("manifest-") and n.endswith(".json"))
        if self.versions:
            self.state = json.loads(read_text(spark, self._manifest(self.versions[-1])))
        else:
            self.state = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "batches": [], "segments": {}}

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifest-{version}.json"

    def _name(self, segment: str) -> str:
        return f"ledger_{zlib.crc32(self.folder.encode()):08x}_{segment}"

    def _segment(self, segment: str) -> DataFrame:
        """The rows of a segment's files, by buckets that a join on the key needn't shuffle."""
        return external_table(self.spark, self._name(segment), ROW, f"{self.folder}/{segment}", KEYS, self.state["buckets"])

    def _live(self, segment: str, among: set[int] | None = None) -> DataFrame:
        """What the ledger still takes from a segment. A file holds one bucket, so files of others are passed over by their statistics."""
        held = set(self.state["segments"][segment])
        wanted = held if among is None else held & among
        rows = self._segment(segment)
        return rows if len(wanted) == self.state["buckets"] else rows.where(F.col("bucket").isin(sorted(wanted)))

    def table(self) -> DataFrame:
        """(k1, k2, copies, first_id); empty before the first batch."""
        parts = [self._live(s).select(*KEYS, "copies", "first_id") for s, held in self.state["segments"].items() if held]
        if not parts:
            return self.spark.createDataFrame([], "k1 long, k2 long, copies long, first_id long")
        return reduce(DataFrame.unionAll, parts)

    def add(self, keys: DataFrame, batch: str | None = None) -> bool:
        """Takes a batch of (id, k1, k2), unless one of its name has been taken; whether it was.

        A batch is aggregated first, so a key that makes up most of it arrives as one row per task. It is then joined fully with the
        ledger's matching buckets, of which nothing is shuffled.
        """
        batch = batch or uuid.uuid4().hex
        if batch in self.state["batches"]:
            return False
        n = self.state["buckets"]
        new = keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).repartition(n, *KEYS)
        new = new.withColumn("b", F.pmod(F.hash(*KEYS), F.lit(n)))  # the very function that puts rows into buckets
        old = self.state["segments"]
        if old:
            new = written(new, "batch")
            touched = {r.b for r in new.select("b").distinct().collect()}
            new = new.repartition(n, *KEYS)
            parts = [self._sum(s, new, touched) for s, held in old.items() if touched & set(held)]
        else:
            touched = set(range(n))
            parts = [new.select(*KEYS, F.col("n").alias("copies"), F.col("id").alias("first_id"), F.col("b").alias("bucket"))]
        segments = {s: sorted(set(held) - touched) for s, held in old.items()}
        segments = {s: held for s, held in segments.items() if held}
        if parts:
            segment = f"s{uuid.uuid4().hex[:12]}"
            reduce(DataFrame.unionAll, parts).write.bucketBy(n, *KEYS).option("path", f"{self.folder}/{segment}").saveAsTable(self._name(segment))
            drop_table(self.spark, self._name(segment))  # it is opened again under the columns' declared types
            segments[segment] = sorted(touched)
        version = self.versions[-1] + 1 if self.versions else 1
        state = {"buckets": n, "batches": [*self.state["batches"], batch], "segments": segments}
        write_new(self.spark, self._manifest(version), json.dumps(state))
        self.state = state
        self.versions.append(version)
        self._tidy(set(segments) | set(old))
        return True

    def _sum(self, segment: str, new: DataFrame, touched: set[int]) -> DataFrame:
        both = touched & set(self.state["segments"][segment])
        part = new if len(both) == self.state["buckets"] else new.where(F.col("b").isin(sorted(both)))
        joined = self._live(segment, both).join(part, KEYS, "full_outer")
        copies = F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))
        return joined.select(*KEYS, copies.alias("copies"), F.least("first_id", "id").alias("first_id"), F.coalesce("bucket", "b").alias("bucket"))

    def _tidy(self, wanted: set[str]) -> None:
        for name in names_in(self.spark, self.folder):
            if name.startswith("s") and name not in wanted:
                drop_table(self.spark, self._name(name))
                remove(self.spark, f"{self.folder}/{name}")
        for version in self.versions[:-2]:
            remove(self.spark, self._manifest(version))
        self.versions = self.versions[-2:]


def time_slices(df: DataFrame, at: str, slices: int) -> list[Column]:
    """Conditions that split df by a timestamp into `slices` parts of equal time; rows without one belong to the first."""
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    if lo is None or slices < 2:
        return [F.lit(True)]
    cut = [F.lit(lo + (hi - lo) * i / slices).cast("timestamp_ntz") for i in range(1, slices)]
    rest = [(F.col(at) >= a) & (F.col(at) < b) for a, b in zip(cut, cut[1:])]
    return [F.col(at).isNull() | (F.col(at) < cut[0]), *rest, F.col(at) >= cut[-1]]


def ledger_of(
    df: DataFrame, id_col: str, scope: list[str], fields: list[str], at: str, slices: int = 3, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(id, k1, k2) of all rows with a key, and the ledger after taking them in the order of `at`, one slice of time after another.

    The ledger lies in `folder`, by default one of its own under the shared folder. Slices are its batches, named by their number.
    """
    keyed = written(copy_keys(df, id_col, scope, fields, at), "keys")
    ledger = Ledger(df.sparkSession, folder)
    for i, part in enumerate(time_slices(keyed, "at", slices)):
        ledger.add(keyed.where(part), f"slice {i}")
    return keyed.select("id", *KEYS), ledger.table()


def copies(keyed: DataFrame, ledger: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """(first_id, copy_id): every copy with the earliest member of its group; one row per copy, so a large group isn't squared.

    Groups of at least heavy_share of all rows, at most 1 / heavy_share of them, are broadcast, so their rows stay in the tasks that read
    them; the others meet their group in a join in which no key holds more than that share.
    """
    groups = ledger.where("copies > 1").select(*KEYS, "first_id", "copies")
    least = F.lit(heavy_share) * ledger.agg(F.coalesce(F.sum("copies"), F.lit(0))).scalar()
    heavy = F.broadcast(groups.where(F.col("copies") >= least).drop("copies"))
    light = groups.where(F.col("copies") < least).drop("copies")
    rest = keyed.join(heavy.select(*KEYS), KEYS, "left_anti").join(light, KEYS)
    found = keyed.join(heavy, KEYS).select("id", "first_id").unionAll(rest.select("id", "first_id"))
    return found.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
