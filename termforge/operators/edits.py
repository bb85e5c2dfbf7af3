"""Edits of dictionaries as new versions of their tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions.modes import Mode
from termforge.functions.patterns import compiled
from termforge.operators.filters import with_any_tag
from termforge.session import written

KEY = ["dictionary_id", "label", "identifier"]


def deduplicated(entries: DataFrame) -> DataFrame:
    """One entry per dictionary, label and identifier: that of the lowest id. Entries with a null in the key are equal if the rest is."""
    first = entries.groupBy(*KEY).agg(F.min("id").alias("id")).select("id")
    return entries.join(first, "id", "left_semi")


def bulk_insert(existing: DataFrame, new: DataFrame, tags: DataFrame, dictionary_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entries, new tags and new entry tags of a load, to be appended.

    new: (line_no, label, identifier, tags array, norm1, norm2), and maybe file, by which lines are ordered first. Keys that exist are skipped, the first of equal new keys wins with its
    tags; entries are gray, clean and searchable. Ids go on from the largest there is, in the order of lines.
    """
    place = ["file", "line_no"] if "file" in new.columns else ["line_no"]
    first = F.row_number().over(Window.partitionBy("label", "identifier").orderBy(*place))
    fresh = new.withColumn("r", first).where("r = 1").drop("r")
    old = existing.where(F.col("dictionary_id") == dictionary_id).select("label", "identifier")
    fresh = fresh.join(old, ["label", "identifier"], "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    entries = numbered(fresh, *place).select(
        (F.col("number") + top).alias("id"),
        F.lit(dictionary_id).cast("long").alias("dictionary_id"),
        "label",
        "identifier",
        "norm1",
        "norm2",
        F.length("label").alias("label_length"),
        F.lit(int(Mode.GRAY)).alias("mode"),
        F.lit(False).alias("dirty"),
        F.lit(True).alias("searchable"),
        "tags",
    )
    here = tags.where(F.col("dictionary_id") == dictionary_id)
    values = entries.select(F.explode("tags").alias("value")).distinct().join(here.select("value"), "value", "left_anti")
    top_tag = tags.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new_tags = numbered(values, "value").select((F.col("number") + top_tag).alias("id"), F.lit(dictionary_id).cast("long").alias("dictionary_id"), "value")
    given = entries.select(F.col("id").alias("entry_id"), F.explode("tags").alias("value")).distinct()
    every = here.select("id", "value").unionByName(new_tags.select("id", "value"))
    return entries.drop("tags"), new_tags, given.join(every, "value").select("entry_id", F.col("id").alias("tag_id"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of columns, without one task seeing all rows: sorted ranges, and their sizes added up."""
    low = (1 << 33) - 1  # the row's place within its partition is the lower part of the generated id
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = written(ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(low).alias("__i")), "numbered")
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "__p").withColumn("number", F.col("start") + F.col("__i") + 1).drop("__p", "__i", "start")


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new in place of those with the same id; a null searchable counts as true."""
    if "searchable" in new.columns:
        new = new.withColumn("searchable", F.coalesce("searchable", F.lit(True)))
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(existing.columns))


def sync_semantic(semantic: DataFrame, entries: DataFrame) -> DataFrame:
    """Vectors with label, identifier and searchable of their entries as these are now; those of deleted entries are dropped."""
    now = entries.select("id", F.col("label").alias("l"), F.col("identifier").alias("i"), F.col("searchable").alias("s"))
    joined = semantic.join(now, "id")
    return joined.withColumns({"label": F.col("l"), "identifier": F.col("i"), "searchable": F.col("s")}).select(semantic.columns)


def semantic_table(entries: DataFrame, dictionary_id: int) -> DataFrame:
    """The vectors of one dictionary as a table of their own."""
    rows = entries.where((F.col("dictionary_id") == dictionary_id) & F.col("embedding").isNotNull())
    return rows.select("id", "dictionary_id", "label", "identifier", F.coalesce("searchable", F.lit(True)).alias("searchable"), "embedding")


@dataclass(frozen=True)
class Emptied:
    entries: DataFrame
    entry_tags: DataFrame
    tags: DataFrame


def empty_entries(entries: DataFrame, entry_tags: DataFrame, tags: DataFrame, dictionary_id: int, mode: int | None) -> Emptied:
    """A dictionary emptied of all entries (None), of those of one mode, or with its black ones back to gray.

    Gray entries that were black stay unsearchable. Other modes raise a ValueError.
    """
    here = F.coalesce(F.col("dictionary_id") == dictionary_id, F.lit(False))
    if mode is None:
        gone, tags = here, tags.where(~here)
    elif mode in (Mode.GRAY, Mode.WHITE, Mode.AUTO_EXPANDED):
        gone = here & F.coalesce(F.col("mode") == int(mode), F.lit(False))
    elif mode == Mode.BLACK:
        gray = F.when(here & (F.col("mode") == int(Mode.BLACK)), F.lit(int(Mode.GRAY))).otherwise(F.col("mode"))
        return Emptied(entries.withColumn("mode", gray.cast(entries.schema["mode"].dataType)), entry_tags, tags)
    else:
        raise ValueError(f"unexpected mode: {mode}")
    dropped = entries.where(gone).select(F.col("id").alias("entry_id"))
    return Emptied(entries.where(~gone), entry_tags.join(dropped, "entry_id", "left_anti"), tags)


def _set_mode(entries: DataFrame, ids: DataFrame, allowed: list[Mode], to: Mode, searchable: bool) -> DataFrame:
    hit = entries.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    wrong = F.col("__hit") & ~F.coalesce(F.col("mode").isin([int(m) for m in allowed]), F.lit(False))
    mode = F.when(wrong, F.raise_error(F.concat(F.lit("mode doesn't allow this: entry "), F.col("id").cast("string"))).cast("int"))
    mode = mode.when(F.col("__hit"), F.lit(int(to))).otherwise(F.col("mode"))
    flag = F.when(F.col("__hit"), F.lit(searchable)).otherwise(F.col("searchable"))
    return hit.withColumns({"mode": mode, "searchable": flag}).select(entries.columns)


def turn_to_white(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return _set_mode(entries, ids, [Mode.GRAY], Mode.WHITE, True)


def turn_to_black(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Gray entries become black and unsearchable; any other mode raises."""
    return _set_mode(entries, ids, [Mode.GRAY], Mode.BLACK, False)


def cancel_black(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return _set_mode(entries, ids, [Mode.BLACK], Mode.GRAY, True)


def confirm(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of any mode, expanded ones for instance, become white."""
    return _set_mode(entries, ids, list(Mode), Mode.WHITE, True)


def undo(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """White entries go, black ones become gray again; others stay."""
    hit = entries.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    left = hit.where(~F.coalesce(F.col("__hit") & (F.col("mode") == int(Mode.WHITE)), F.lit(False)))
    black = F.coalesce(F.col("__hit") & (F.col("mode") == int(Mode.BLACK)), F.lit(False))
    mode = F.when(black, F.lit(int(Mode.GRAY))).otherwise(F.col("mode"))
    return left.withColumns({"mode": mode, "searchable": black | F.col("searchable")}).select(entries.columns)


def searchable_by_tags(entries: DataFrame, entry_tags: DataFrame, tags: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries searchable if they have one of the tag values, all of them without values; and how many changed each way."""
    tagged = with_any_tag(entries, entry_tags, tags, values).select("id").withColumn("__now", F.lit(True))
    now = entries.join(tagged.distinct(), "id", "left").withColumn("__now", F.coalesce("__now", F.lit(False)))
    changes = now.agg(
        F.count_if(F.col("searchable") & ~F.col("__now")).alias("made_unsearchable"), F.count_if(~F.col("searchable") & F.col("__now")).alias("made_searchable")
    )
    return now.withColumn("searchable", F.col("__now")).select(entries.columns), changes


def create_entries(existing: DataFrame, wanted: DataFrame, norm1: Column, norm2: Column) -> DataFrame:
    """Entries made by hand from (dictionary_id, label, identifier): stripped, both parts given, not there yet; white, dirty, searchable."""
    w = wanted.select("dictionary_id", F.trim("label").alias("label"), F.trim("identifier").alias("identifier")).where("label <> '' AND identifier <> ''")
    w = w.distinct().join(existing.select(*KEY), KEY, "left_anti")
    return w.select(
        *KEY, norm1.alias("norm1"), norm2.alias("norm2"), F.length("label").alias("label_length"), F.lit(int(Mode.WHITE)).alias("mode"), F.lit(True).alias("dirty"), F.lit(True).alias("searchable")
    )


def add_patterns(patterns: DataFrame, dictionary_id: int, new: list[tuple[str, str]]) -> DataFrame:
    """Patterns with new ones of (expression, identifier), active, numbered on from the largest id; a ValueError for an expression that can't be used."""
    for expression, _ in new:
        compiled(expression)
    rows = patterns.sparkSession.createDataFrame([(i, dictionary_id, e, o, True) for i, (e, o) in enumerate(new, 1)], "n long, dictionary_id long, expression string, identifier string, active boolean")
    top = patterns.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return patterns.unionByName(rows.withColumn("id", F.col("n") + top).select(patterns.columns))


def toggle_patterns(patterns: DataFrame, ids: list[int]) -> DataFrame:
    return patterns.withColumn("active", F.when(F.col("id").isin(ids), ~F.col("active")).otherwise(F.col("active")))


def empty_patterns(patterns: DataFrame, dictionary_id: int) -> DataFrame:
    return patterns.where(~F.coalesce(F.col("dictionary_id") == dictionary_id, F.lit(False)))


def patterns_num(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("dictionary_id").agg(F.count(F.lit(1)).alias("patterns_num"))


def update_tags(tags: DataFrame, entry_tags: DataFrame, dictionary_id: int, wanted: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags of a dictionary to add, to remove, and those not wanted that can't be removed because entries use them."""
    spark = tags.sparkSession
    want = spark.createDataFrame([(v,) for v in dict.fromkeys(wanted)], "value string")
    here = tags.where(F.col("dictionary_id") == dictionary_id)
    add = want.join(here.select("value"), "value", "left_anti")
    surplus = here.join(want, "value", "left_anti")
    used = entry_tags.select(F.col("tag_id").alias("id"))
    return add, surplus.join(used, "id", "left_anti"), surplus.join(used, "id", "left_semi")


def expand_synonyms(entries: DataFrame, before: Column, per_identifier: int = 2, seed: int = 1) -> DataFrame:
    """Placeholder synonyms of active entries made before a time: numbered labels per identifier with a seeded score; mode auto-expanded."""
    active = entries.where(F.col("mode").isin(0, 1) & (F.col("created_at") < before) & F.col("identifier").isNotNull() & F.col("label").isNotNull())
    first = active.groupBy("dictionary_id", "identifier").agg(F.min("label").alias("label"))
    made = first.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_identifier - 1))))
    score = (F.pmod(F.xxhash64("dictionary_id", "identifier", "i", F.lit(seed)), F.lit(10000)) / 10000).cast("decimal(5,4)")
    label = F.concat("label", F.lit("--dummy-synonym-"), F.col("i").cast("string"))
    return made.select("dictionary_id", label.alias("label"), "identifier", F.lit(int(Mode.AUTO_EXPANDED)).alias("mode"), score.alias("score"))


def compile_dictionary(entries: DataFrame) -> DataFrame:
    """Entries with white ones no longer dirty."""
    return entries.withColumn("dirty", F.col("dirty") & ~F.coalesce(F.col("mode") == int(Mode.WHITE), F.lit(False)))


def reset_searchable(entries: DataFrame) -> DataFrame:
    """As before embedding: all searchable but black ones."""
    return entries.withColumn("searchable", F.coalesce(F.col("mode") != int(Mode.BLACK), F.lit(True)))
