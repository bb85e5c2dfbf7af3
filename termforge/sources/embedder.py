"""Vectors of texts from an embedding service, or from a stand-in without a network."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


class ClientError(ValueError):
    """The request was wrong; trying again is of no use."""


class ServerError(RuntimeError):
    """The service failed."""


def fetch(url: str, texts: list[str], model: str | None = None, timeout: float = 30) -> list[list[float]]:
    body = json.dumps({"input": texts} | ({"model": model} if model else {})).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            vectors = json.load(r)["embeddings"]
    except urllib.error.HTTPError as e:
        raise (ClientError if 400 <= e.code < 500 else ServerError)(f"{e.code}: {e.reason}") from e
    if len(vectors) != len(texts):
        raise ServerError(f"{len(vectors)} vectors for {len(texts)} texts")
    return vectors


def with_retry(call: Callable[[], list], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> list:
    """Tries again after time-outs and refused connections, waiting 2, 4 and 6 seconds."""
    for n in range(1, tries + 1):
        try:
            return call()
        except (TimeoutError, ConnectionError, urllib.error.URLError) as e:
            if n == tries:
                raise ServerError(f"no answer after {tries} tries: {e}") from e
            wait(2 * n)
    return []


def models(url: str) -> list[str]:
    try:
        with urllib.request.urlopen(url, timeout=10) as r:
            return [m["name"] if isinstance(m, dict) else m for m in json.load(r).get("models", [])]
    except (OSError, ValueError):
        return []


def service_embedder(url: str, model: str | None = None, batch: int = 50):
    """A column function that embeds strings in batches, one connection at a time per task."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = [None] * len(s)
            given = [i for i, t in enumerate(s) if t]
            for at in range(0, len(given), batch):
                chunk = given[at : at + batch]
                for i, v in zip(chunk, with_retry(lambda c=chunk: fetch(url, [s.iloc[i] for i in c], model))):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return embed
