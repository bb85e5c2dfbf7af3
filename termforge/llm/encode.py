"""Token ids of whole texts by a public byte-level BPE, by joining the ids of halves."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.util import find_spec
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.session import spread

#: Fixed value: how the public tokenizers' description says that a text is split into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A place that is a word's end in whatever text it stands: no word holds a letter and then a non-letter, a digit and then a non-digit, or
#: anything visible and then a space.
SURE_PLACE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)"
SURE, SURE_BACKWARDS = regex.compile(SURE_PLACE), regex.compile(f"(?r){SURE_PLACE}")
EMPTY = np.empty(0, np.uint32)
#: Characters of a leaf: a few sentences, so that most documents are joined from halves.
LEAF = 512


def tokenizer_folder() -> str:
    """Folder of the installed public vocabularies."""
    spec = find_spec("public_tokenizers")
    if spec is None or spec.origin is None:
        raise FileNotFoundError("name the vocabulary's file: the package of public tokenizers isn't installed")
    return str(Path(spec.origin).parent)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """One per Python worker."""
    import tiktoken

    coding = tiktoken.Encoding(Path(path).stem, pat_str=WORDS, mergeable_ranks=vocabulary(path), special_tokens={})
    return lambda text: np.array(coding.encode_ordinary(text), np.uint32)


def _last_sure(text: str, window: int) -> int:
    """Start of the window at the end of text: the last sure place, sought in ever longer tails."""
    while True:
        at = max(0, len(text) - window)
        m = SURE_BACKWARDS.search(text, at)
        if m and m.start() > at:
            return m.start()
        if at == 0:
            return 0
        window *= 2


def _first_sure(text: str, window: int) -> int:
    """End of the window at the start of text: the first sure place, sought in ever longer heads; the last character needs its next one."""
    while True:
        m = SURE.search(text, 1, min(len(text), window))
        if m and m.start() < len(text):
            return m.start()
        if window >= len(text):
            return len(text)
        window *= 2


def encode_text(text: str, encode: Callable[[str], np.ndarray], leaf: int = LEAF, window: int = 24) -> np.ndarray:
    """Ids of text as a tree: halves are encoded and joined, down to leaves of at most `leaf` characters.

    Ids form a monoid under join(): the ids of l + r are those of l without its last words, those of the window l[b:] + r[:e],
    and those of r without its first words. b and e are places where a word ends in any text (see SURE), so what lies outside the window
    is split and merged as in the whole text; where no such place is near, the window grows, at most to the whole of both halves.
    """
    if len(text) <= leaf:
        return encode(text) if text else EMPTY
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return join(left, encode_text(left, encode, leaf, window), right, encode_text(right, encode, leaf, window), encode, window)


def join(left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray, encode: Callable[[str], np.ndarray], window: int = 24) -> np.ndarray:
    b, e = _last_sure(left, window), _first_sure(right, window)
    tail, head = left[b:], right[:e]
    drop_left, drop_right = len(encode(tail)) if tail else 0, len(encode(head)) if head else 0
    return np.concatenate([left_ids[: len(left_ids) - drop_left], encode(tail + head), right_ids[drop_right:]])


@lru_cache(maxsize=4)
def _pieces(path: str) -> list[bytes]:
    ranks = vocabulary(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, n in ranks.items():
        out[n] = piece
    return out


def decode_bytes(ids: list[int] | np.ndarray, path: str, leaf: int = 4096) -> bytes:
    """Bytes of ids, concatenated up the tree of their halves; a character may be spread over tokens, so only the whole is text."""
    if len(ids) <= leaf:
        pieces = _pieces(path)
        return b"".join(pieces[i] for i in ids)
    half = len(ids) // 2
    return decode_bytes(ids[:half], path, leaf) + decode_bytes(ids[half:], path, leaf)


def _ids(path: str, leaf: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                parts, ends = [], [0]
                for t in b.column(1):
                    t = t.as_py()
                    ids = EMPTY if t is None else encode_text(t, encode, leaf)
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids))
                flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.record_batch({"id": b.column(0), "ids": ids})

    return run


def _sizes(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in batches:
            n = [0 if (t := x.as_py()) is None else len(encode_text(t, encode, leaf)) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "tokens"])

    return run


def token_ids(df: DataFrame, id_col: str, text: str, vocabulary: str | None = None, leaf: int = LEAF, rows: int = 256) -> DataFrame:
    """(id_col, ids): the ids of each text, without special tokens; one narrow pass, but that tables of fewer files than cores are spread first.

    vocabulary is a file of ranks, by default byte_bpe_50k. Null and empty texts give an empty list; strings of special tokens in a text are
    ordinary text. Texts of any length are encoded whole, in leaves of `leaf` characters; `rows` bounds what a task holds at once. One
    row per row of df; other columns don't matter.
    """
    path = vocabulary or f"{tokenizer_folder()}/byte_bpe_50k.tiktoken"
    out = spread(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "id")
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(_ids(path, leaf, rows), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def with_token_count(df: DataFrame, keep: list[str], text: str, vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """keep + tokens: the number of ids of each text, 0 for null and empty ones."""
    path = vocabulary or f"{tokenizer_folder()}/byte_bpe_50k.tiktoken"
    out = df.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in keep)
    return spread(out, "__text").mapInArrow(_sizes(path, leaf), f"{kinds}, tokens long")
