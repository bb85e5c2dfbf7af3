"""Arrow-batched wrappers of the text kernels."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from termforge.functions import text as kernels
from termforge.functions.normalize_text import normalize_str as keeping_gaps

TOKEN_TYPE = ArrayType(
    StructType(
        [StructField("token", StringType()), StructField("norm2", StringType()), StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("level", IntegerType())]
    )
)


@F.pandas_udf(StringType())
def normalize1(s: pd.Series) -> pd.Series:
    return s.map(kernels.normalize1, na_action="ignore")


@F.pandas_udf(StringType())
def normalize2(s: pd.Series) -> pd.Series:
    return s.map(kernels.normalize2, na_action="ignore")


@F.pandas_udf(StructType([StructField("norm1", StringType()), StructField("norm2", StringType())]))
def norms(s: pd.Series) -> pd.DataFrame:
    """Both norms of a string, whose words are found once; null stays null."""
    both = [(None, None) if t is None else kernels.norms(t) for t in s]
    return pd.DataFrame(both, columns=["norm1", "norm2"], dtype=object)


def _tokens(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    toks = kernels.tokens(text)
    kernels.add_levels(toks, text, kernels.sentence_breaks(text))
    return [{"token": t.norm1, "norm2": t.norm2, "begin": t.begin, "end": t.end, "level": t.level} for t in toks]


@F.pandas_udf(TOKEN_TYPE)
def tokenize(s: pd.Series) -> pd.Series:
    return s.map(_tokens)


@F.pandas_udf(ArrayType(IntegerType()))
def sentence_breaks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else kernels.sentence_breaks(t))


@F.pandas_udf(IntegerType())
def crossings(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else kernels.crossings(t) for t in s], dtype="Int32")


@F.pandas_udf(StringType())
def abbreviation_type(short: pd.Series, full: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None or not a else kernels.abbreviation_type(a, b) for a, b in zip(short, full)], dtype=object)


@F.pandas_udf(StringType())
def decapitalize(s: pd.Series) -> pd.Series:
    return s.map(kernels.decapitalize, na_action="ignore")


@F.pandas_udf(StringType())
def normalize_str(s: pd.Series) -> pd.Series:
    return s.map(lambda t: keeping_gaps(t, stems=True, lowercase=True, hyphens_to_spaces=True), na_action="ignore")


SIMPLE = ArrayType(StructType([StructField("piece", StringType()), StructField("begin", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(SIMPLE)
def simple_tokens(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else [{"piece": a, "begin": b, "end": e} for a, b, e in kernels.simple_tokens(t)])


def filename(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "_")


def worth_embedding(c: Column) -> Column:
    return (F.length(c) >= 3) & ~c.rlike(r"^[0-9.\-+,\s]+$")


@lru_cache(maxsize=1 << 18)
def _trigram_hash(k: int) -> int:
    """Of a trigram given as its three code points of 21 bits each."""
    trigram = chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF)
    return int.from_bytes(hashlib.blake2b(trigram.encode(), digest_size=8).digest(), "little")


def hash_embedding(texts: list[str], dim: int) -> np.ndarray:
    """A stand-in for a model without a network: the mean of hashed trigrams, at length 1. The same text always gives the same vector."""
    padded = [f"  {t.lower()}  " for t in texts]
    n = np.array([len(s) for s in padded], np.int64)
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    inside = np.ones(len(points), bool)  # where a trigram of one text begins
    ends = np.cumsum(n)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    which, keys = pd.factorize(points[at] << np.uint64(42) | points[at + 1] << np.uint64(21) | points[at + 2])
    h = np.array([_trigram_hash(k) for k in keys.tolist()], np.uint64)
    bucket, sign = (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    cells = np.repeat(np.arange(len(texts)), n - 2) * dim + bucket[which]
    out = np.bincount(cells, sign[which], len(texts) * dim).astype(np.float32).reshape(len(texts), dim)
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm, norm, 1)[:, None]


def hash_embedder(dim: int = 64):
    """An embedder as a column function; any Arrow or pandas UDF from strings to arrays of floats can stand in its place."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def embed(s: pa.Array) -> pa.Array:
        values = pa.array(hash_embedding([t or "" for t in s.to_pylist()], dim).astype(float).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * dim), values, mask=s.is_null())

    return embed
