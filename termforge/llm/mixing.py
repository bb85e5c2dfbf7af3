"""Mixing sources to target shares of the total size, with a cap on repeats."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.llm.encode import with_token_count
from termforge.session import written


def fill(lengths: list[int], counts: list[int], budget: int, reach: int = 16384) -> list[int]:
    """How many texts of each length to take so that their sizes add up to budget, or to the most below it that is found.

    All but half of `reach` is taken in proportion to the counts, so the choice stays a fair picture of the source: the part of a text by which a
    length's share is rounded down is carried on to the next length, so lengths that occur once get their share too. What is left of the
    budget, about `reach` or one text, is filled by bounded-knapsack dynamic programming: counts are split into powers
    of two, the reachable sums are the bits of one integer per step, and walking back over the steps gives the counts.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    bulk = max(0, budget - reach // 2)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    take, carried = [0] * len(counts), 0
    for i in order:  # from the longest down, rounding never takes more than bulk, and less by one text at most
        take[i], carried = divmod(counts[i] * bulk + carried, total)
    left = budget - sum(n * t for n, t in zip(lengths, take))
    for i in order:
        if left > reach and lengths[i] > 0:
            more = min(counts[i] - take[i], (left - reach) // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    steps, sums, room = [], 1, (1 << (left + 1)) - 1
    for i in order:
        spare, power = min(counts[i] - take[i], left // lengths[i] if lengths[i] else 0), 1
        while spare > 0 and not sums >> left & 1:
            n = min(power, spare)
            steps.append((i, n, sums))
            sums |= (sums << n * lengths[i]) & room
            spare, power = spare - n, power * 2
    at = sums.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * lengths[i]
    return take


@dataclass(frozen=True)
class SourcePlan:
    source: str
    weight: float
    max_repeats: int
    available: int
    budget: int
    whole: int
    rest: int


def plan(available: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> list[SourcePlan]:
    """Budget of each source: its weight of `total`, at most max_repeats times what it has.

    By default total is the most for which every source that has anything can give its full share.
    """
    given = [(s, float(w), int(m)) for s, w, m in targets if s is not None and w is not None and w > 0 and m is not None and m > 0]
    caps = [available.get(s, 0) * m / w for s, w, m in given if available.get(s, 0)]
    size = (min(caps) if caps else 0) if total is None else total
    plans = []
    for s, w, m in given:
        have = available.get(s, 0)
        budget = min(round(w * size), have * m)
        whole = budget // have if have else 0
        plans.append(SourcePlan(s, w, m, have, budget, whole, budget - whole * have))
    return plans


def sized_documents(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens) of the texts that take part: source among the targets, at least one token. Written, as counting is the main work."""
    named = targets.where("weight > 0 AND max_repeats > 0").select(F.col("source").alias("__source")).distinct()
    part = docs.join(named, F.col(source) == F.col("__source"), "left_semi")
    part = part.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return written(with_token_count(part, ["doc_id", "source"], "text").where("tokens > 0"), "sized")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 1, total: int | None = None, slices: int = 256) -> tuple[DataFrame, list[SourcePlan]]:
    """Documents of the mix with their number of copies, and the plan.

    A source gives whole repeats of all its texts and then texts once more for the rest of its budget. How many of each exact length is
    found by fill() from counts by length, one row per length, on the executors; which of them is decided by a seeded hash of
    the id. Picking n of many texts of one length is cut into slices of the hash: whole slices are taken by their counts, and only
    the slice on the border is ranked, so that a length that a third of all texts share is spread over `slices` groups.

    Null and empty texts, sources without target, and targets with a null or non-positive weight or cap take no part. Ties between repeated
    ids fall to either row. No text is used more than max_repeats times. An empty table gives an empty mix.
    """
    hist = sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    available = {r.source: int(r.t) for r in hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).collect()}
    plans = plan(available, [(r.source, r.weight, r.max_repeats) for r in targets.collect()], total)
    rest = {p.source: p.rest for p in plans}

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tokens")
        take = fill([int(x) for x in group["tokens"]], [int(x) for x in group["n"]], rest.get(group["source"].iloc[0], 0))
        return pd.DataFrame({"source": group["source"].to_numpy(), "tokens": group["tokens"].to_numpy(), "take": take})

    takes = hist.groupBy("source").applyInPandas(choose, "source string, tokens long, take long")
    hashed = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("slice", F.pmod("h", F.lit(slices)).cast("int"))
    key = ["source", "tokens", "slice"]
    counts = hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_slice"))
    before = Window.partitionBy("source", "tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("before", F.coalesce(F.sum("n_slice").over(before), F.lit(0))).join(takes, ["source", "tokens"])
    cut = cut.select(*key, F.greatest(F.lit(0), F.least("n_slice", F.col("take") - F.col("before"))).alias("quota"), "n_slice")
    rows = hashed.join(cut, key)
    border = (F.col("quota") > 0) & (F.col("quota") < F.col("n_slice"))
    ranked = rows.where(border).withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id")))
    extra = ranked.select("doc_id", "source", "tokens", (F.col("r") <= F.col("quota")).cast("int").alias("more"))
    plain = rows.where(~border).select("doc_id", "source", "tokens", (F.col("quota") > 0).cast("int").alias("more"))
    whole = F.coalesce(*[F.when(F.col("source") == p.source, F.lit(p.whole)) for p in plans], F.lit(0))
    out = plain.unionByName(extra).select("doc_id", "source", "tokens", (whole + F.col("more")).alias("copies"))
    return out.where("copies > 0"), plans


def shares(mixed: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """What each source was to give and gives: tokens, share of the mix, texts and repeats."""
    spark = mixed.sparkSession
    wanted = spark.createDataFrame(
        [(p.source, p.weight, p.max_repeats, p.available, p.budget) for p in plans],
        "source string, weight double, max_repeats int, available_tokens long, budget_tokens long",
    )
    given = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        F.count(F.lit(1)).alias("n_documents"),
        F.max("copies").alias("most_copies"),
    )
    rows = wanted.join(given, "source", "left").fillna(0, ["tokens", "n_documents", "most_copies"])
    return rows.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
