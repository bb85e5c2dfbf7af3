"""Set-similarity join of strings by their n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions.similarity import circular_bigrams, circular_trigrams, let, unigrams

GRAMS = {1: unigrams, 2: circular_bigrams, 3: circular_trigrams}


def postings(strings: DataFrame, value: str, n: int = 3) -> DataFrame:
    """(value, n_grams, gram): distinct grams of every distinct non-null string; what an n-gram index holds."""
    sets = strings.where(F.length(value) > 0).select(value).distinct().withColumn("grams", F.array_distinct(GRAMS[n](F.col(value))))
    return sets.select(value, F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))


def _sets(df: DataFrame, value: str, n: int) -> DataFrame:
    """Distinct strings with their grams, in a fixed number of partitions: work on grams costs far more than the size of strings tells."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets = df.where(F.length(value) > 0).select(F.col(value).alias("v")).distinct().repartition(parts, "v")
    return sets.withColumn("g", F.array_distinct(GRAMS[n](F.col("v"))))


SLOTS = 4096
WORDS = ["w0", "w1", "w2", "w3"]


def _signature(g: Column) -> list[Column]:
    """256 bits, each gram setting one: what bits a set has beyond another's are grams that the other lacks."""
    bits = F.transform(g, lambda x: F.pmod(F.xxhash64(F.lit("bit"), x), F.lit(64 * len(WORDS))).cast("int"))

    def word(i: int) -> Column:
        here = F.filter(bits, lambda b: F.shiftright(b, 6) == i)
        return F.aggregate(here, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))))

    return [word(i).alias(w) for i, w in enumerate(WORDS)]


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def _frequencies(sets: DataFrame) -> Column:
    """How many grams fall into each of SLOTS slots of their hash: a table of fixed size, as a constant."""
    slots = sets.select(F.explode("g").alias("gram")).groupBy(_slot(F.col("gram")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    counts = [0] * SLOTS
    for r in slots.collect():
        counts[r.slot] = r.n
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<long>")


def _prefixes(sets: DataFrame, frequencies: Column, keep: Column) -> DataFrame:
    """Each set's first grams in one order of all grams, as many as any partner of enough similarity must share one of.

    Grams of rare slots come first, so what joins is rare; any order common to both sides would be right. The order is made
    within each row, without a join or a shuffle.
    """
    order = F.transform("g", lambda x: F.struct(F.get(frequencies, _slot(x)).alias("n"), F.xxhash64(x).alias("h"), x.alias("x")))
    first = F.slice(F.array_sort(order), F.lit(1), F.greatest(F.lit(1), keep.cast("int")))
    rows = sets.select("v", F.size("g").alias("n"), "g", *_signature(F.col("g")))
    return rows.select("v", "n", *WORDS, F.explode(F.transform(first, lambda s: s["x"])).alias("gram"))


def similarity_join(left: DataFrame, left_col: str, right: DataFrame, right_col: str, threshold: float, n: int = 3, measure: str = "jaccard") -> DataFrame:
    """(left, right, similarity): distinct strings of both sides whose gram sets are at least `threshold` similar.

    measure is jaccard or cosine. Exact: a pair that is similar enough shares one of the first grams of either side (prefix filter) and
    has sizes within bounds (length filter); of these, pairs whose signatures show that too many grams differ drop out within the join, and
    what is left is verified. Empty and null
    strings take no part.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    a, b = _sets(left, left_col, n), _sets(right, right_col, n)
    frequent = _frequencies(b)
    t = threshold if measure == "jaccard" else threshold**2
    keep = F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1
    pa, pb = _prefixes(a, frequent, keep), _prefixes(b, frequent, keep)
    fits = (F.col("pb.n") >= F.ceil(F.col("pa.n") * t - 1e-9)) & (F.col("pb.n") <= F.floor(F.col("pa.n") / t + 1e-9))
    beyond = lambda x, y: sum((F.bit_count(F.col(f"{x}.{w}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{w}")))) for w in WORDS), F.lit(0))
    most = F.least(F.col("pa.n") - beyond("pa", "pb"), F.col("pb.n") - beyond("pb", "pa"))
    product = F.sqrt(F.col("pa.n").cast("double") * F.col("pb.n"))
    fits = fits & (most >= (F.col("pa.n") + F.col("pb.n")) * (t / (1 + t)) - 1e-9 if measure == "jaccard" else most >= product * threshold - 1e-9)
    met = pa.alias("pa").join(pb.alias("pb"), F.col("pa.gram") == F.col("pb.gram")).where(fits)
    # the similarity hangs on the count of shared grams, so no rule can move the verification below this aggregate and into the join
    pairs = met.groupBy(F.col("pa.v").alias("left"), F.col("pb.v").alias("right")).agg(F.count(F.lit(1)).alias("met"))
    both = F.when(F.col("met") > 0, _similarity(F.array_distinct(GRAMS[n](F.col("left"))), F.array_distinct(GRAMS[n](F.col("right"))), measure))
    return pairs.select("left", "right", both.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def _similarity(x: Column, y: Column, measure: str) -> Column:
    """Of two gram sets; both, and what they share, are evaluated once."""

    def of(v: Column) -> Column:
        a, b, shared = F.size(v["x"]), F.size(v["y"]), F.size(F.array_intersect(v["x"], v["y"]))
        return let(shared, lambda c: c / (a + b - c) if measure == "jaccard" else c / F.sqrt(a.cast("double") * b))

    return let(F.struct(x.alias("x"), y.alias("y")), of)
