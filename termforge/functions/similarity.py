"""String similarity as column expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value) with value evaluated once: as the variable of a lambda, not as copies of its expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _windows(s: Column, padded: Column, n: int) -> Column:
    """All substrings of length n of padded, one per character of s; an empty or null s has none."""
    grams = let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, F.lit(n))))
    return F.when(F.length(s) > 0, grams).otherwise(F.array().cast("array<string>"))


def unigrams(s: Column) -> Column:
    return _windows(s, s, 1)


def circular_bigrams(s: Column) -> Column:
    return _windows(s, F.concat(s, F.left(s, F.lit(1))), 2)


def circular_trigrams(s: Column) -> Column:
    return _windows(s, F.concat(F.right(s, F.lit(1)), s, F.left(s, F.lit(1))), 3)


def _let(a: Column, b: Column, then) -> Column:
    """then(a, b) with both evaluated once: as the variable of a lambda, not as copies of their expressions."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: then(v["a"], v["b"]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return _let(
        a, b, lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))
    )


def _jaccard_of(grams, a: Column, b: Column) -> Column:
    """jaccard() of the grams of two strings; equal strings need none."""
    return F.when((a == b) & (F.length(a) > 0), F.lit(1.0)).otherwise(jaccard(grams(a), grams(b)))


def _str_sim(grams, a: Column, b: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    surface, one, two = _jaccard_of(grams, a, b), _jaccard_of(grams, a1, b1), _jaccard_of(grams, a2, b2)
    return F.when((a2 == "") & (b2 == ""), (surface + one) / 2).otherwise((surface + one + two * 10) / 12)


def str_sim_3gram(a: Column, b: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Similarity of two labels from the trigrams of the labels, of norm1 and, ten times, of norm2."""
    return _str_sim(circular_trigrams, a, b, a1, b1, a2, b2)


def str_sim_2gram(a: Column, b: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return _str_sim(circular_bigrams, a, b, a1, b1, a2, b2)


def _gram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two gram arrays; 0 if either is empty."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x)).cast("double")
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, x: s + count(a, x) * count(b, x))
    norm = lambda xs: F.sqrt(F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda s, x: s + count(xs, x) * count(xs, x)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def gram_cosine(a: Column, b: Column) -> Column:
    return _let(a, b, _gram_cosine)


def plain_bigrams(s: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(F.length(s) > 1, grams).otherwise(F.array().cast("array<string>"))


def str_sim_jp(a: Column, b: Column) -> Column:
    """Japanese: cosine over characters, 0.7, and over pairs of characters, 0.3, of the labels as they are."""
    return gram_cosine(unigrams(a), unigrams(b)) * 0.7 + gram_cosine(plain_bigrams(a), plain_bigrams(b)) * 0.3


def str_sim(language: Column, a: Column, b: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """By the dictionary's language: Korean by bigrams, Japanese by characters, all others by trigrams."""
    return (
        F.when(language == "kor", str_sim_2gram(a, b, a1, b1, a2, b2)).when(language == "jpn", str_sim_jp(a, b)).otherwise(str_sim_3gram(a, b, a1, b1, a2, b2))
    )


def scored(df: DataFrame, score: Column) -> DataFrame:
    """df with a column `score`, evaluated once a row: as a generator's output, which no filter on it can pass on the way into a join."""
    return df.select("*", F.explode(F.array(score)).alias("score"))


def numbered_ngrams(s: Column, n: int = 4, both_ends: bool = True) -> Column:
    """Features of approximate string matching: n-grams of the string padded with U+0001, the k-th repeat of a gram marked #k."""
    pad = F.lit("\x01" * (n - 1))
    full = F.concat(pad, s, pad) if both_ends else F.when(F.length(s) < n, F.rpad(s, n, "\x01")).otherwise(s)
    grams = F.transform(F.sequence(F.lit(1), F.length(full) - (n - 1)), lambda i: F.substring(full, i, F.lit(n)))
    return F.transform(
        grams, lambda g, i: F.concat(g, F.lit("#"), (F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g))).cast("string"))
    )


def feature_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def feature_cosine(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))
