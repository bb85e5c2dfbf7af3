"""Finding and restoring text that was read with the wrong character encoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.garble_model import ENTER_MULTI, ENTER_SINGLE, LEAVE, STATES, WRONG, Model
from termforge.session import spread

ENTER = np.array([ENTER_MULTI if s.was in ("utf-8", "shift_jis", "euc_jp") else ENTER_SINGLE for s in STATES], np.float32)
#: Below this gain in all states it pays to leave a state and enter it again, so the best path is clean there.
CLEAN = -float(ENTER.max()) - LEAVE - 0.01
Span = tuple[int, int, int]  # begin, end, number of the state
LOST = "\ufffd"
PIECE, BLOCK, HELD, MARGIN = 50_000, 200_000, 200_000, 32


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with a line feed before, between and after them, and where each begins."""
    joined = "\n" + "\n".join(texts) + "\n"
    begin = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32), begin


def _stretches(gain: np.ndarray, new_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First characters and lengths of the stretches in which a state other than clean may win, and which characters are clean for certain.

    The path is clean at a character that all states read badly, so stretches between such characters are independent. In one, the
    path is clean throughout if no state gains more than it costs to enter from any run of characters.
    """
    certain = gain.max(1) < CLEAN
    opens = ~certain & (new_text | np.r_[True, certain[:-1]])
    first = np.flatnonzero(opens)
    if not len(first):
        return first, first, certain
    inside = np.where(certain, 0, np.cumsum(opens))
    length = np.bincount(inside, minlength=len(first) + 1)[1:]
    hopes = np.add.reduceat(np.where(certain, 0, np.maximum(gain.max(1), 0)), first) > ENTER.min()
    rows = np.flatnonzero(~certain & hopes[inside - 1])
    total = np.cumsum(gain[rows], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, total.shape[1])), total[:-1]]), axis=0) if len(rows) else total
    won = np.zeros(len(first), bool)
    won[inside[rows[((total - low) > ENTER - 0.001).any(1)]] - 1] = True
    return first[won], length[won], certain


def _best_paths(gain: np.ndarray, first: np.ndarray, length: np.ndarray, ends_text: np.ndarray) -> np.ndarray:
    """State of every character on the best path, -1 for clean; for all stretches at once, step t taking the t-th character of each."""
    n, k = len(first), len(STATES)
    state = np.full(len(gain), -1, np.int16)
    order = np.argsort(-length, kind="stable")
    first, length, ends_text = first[order], length[order], ends_text[order]
    clean, v = np.zeros(n, np.float32), np.full((n, k), -1e9, np.float32)
    entered, left = np.zeros((len(gain), k), bool), np.full(len(gain), -1, np.int16)
    live = np.searchsorted(-length, -np.arange(int(length[0]) if n else 0), "left")
    for t, m in enumerate(live):
        i = first[:m] + t
        new = clean[:m, None] - ENTER
        entered[i] = new > v[:m]
        best = v[:m].argmax(1)
        out = v[np.arange(m), best] - LEAVE
        go = out > clean[:m]
        left[i] = np.where(go, best, -1)
        v[:m] = np.maximum(v[:m], new) + gain[i]
        clean[:m] = np.where(go, out, clean[:m])
    best = v.argmax(1)
    now = np.where(v[np.arange(n), best] - np.where(ends_text, 0, LEAVE) > clean, best, -1)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        i, here = first[:m] + t, now[:m]
        state[i] = here
        stays = (here >= 0) & ~entered[i, np.maximum(here, 0)]
        now[:m] = np.where(stays, here, np.where(here >= 0, -1, left[i]))
    return state


@dataclass
class Read:
    """Texts as far as the path needs them: where their characters beyond ASCII are, and the gains of the stretches that aren't surely clean."""

    doc: np.ndarray  # of each row of gain, its text
    at: np.ndarray  # and place in it
    gain: np.ndarray
    first: np.ndarray
    length: np.ndarray
    ends_text: np.ndarray
    upto: list[int]


def read(texts: list[str], goes_on: list[bool]) -> Read:
    """Gains of the stretches of texts in which the path may leave the clean state, and up to where each text's spans are certain.

    Characters of ASCII read alike in all states, so the path runs over the others only. Of these, such as no encoding has a byte for are read badly by all
    states, so only what lies beside others is looked at.
    A text that goes on beyond what is given is certain up to its last character that is clean whatever follows, others to their end.
    """
    m = model()
    cp, begin = code_points(texts)
    at = np.flatnonzero(cp >= 0x80)
    legible = m.legible[np.minimum(cp[at], 0xFFFF)] & (cp[at] < 0x10000)
    near = np.zeros(len(cp), bool)
    for d in range(-2, 3):
        near[np.clip(at[legible] + d, 0, len(cp) - 1)] = True
    gain = np.full((len(at), len(STATES)), WRONG, np.float32)
    gain[near[at]] = m.gains(cp[near])
    doc = np.searchsorted(begin, at, "right") - 1
    first, length, certain = _stretches(gain, np.r_[True, doc[1:] != doc[:-1]][: len(at)])
    after = first + length
    ends_text = (after == len(at)) | (doc[np.minimum(after, len(at) - 1)] != doc[first]) if len(at) else np.empty(0, bool)
    place = at - begin[doc]
    upto = [len(t) for t in texts]
    for d, more in enumerate(goes_on):
        if more:
            sure = place[certain & (doc == d)]
            sure = sure[sure < len(texts[d]) - MARGIN]
            upto[d] = int(sure[-1]) + 1 if len(sure) else 0
    start = np.cumsum(length) - length
    rows = np.repeat(first - start, length) + np.arange(int(length.sum()))
    return Read(doc[rows], place[rows], gain[rows], start, length, ends_text, upto)


def label(parts: list[Read]) -> list[tuple[int, int, Span]]:
    """(part, text, span) of all that the model's best path gives to a state other than clean; one path over all parts at once."""
    rows = np.cumsum([0] + [len(p.gain) for p in parts])
    first = np.concatenate([p.first + n for p, n in zip(parts, rows)])
    gain, doc, at = (np.concatenate([getattr(p, c) for p in parts]) for c in ("gain", "doc", "at"))
    state = _best_paths(gain, first, np.concatenate([p.length for p in parts]), np.concatenate([p.ends_text for p in parts]))
    new = np.zeros(len(at) + 1, bool)
    new[[0, len(at), *first]] = True
    new[1:-1] |= state[1:] != state[:-1]
    odd = state >= 0
    opens, closes = np.flatnonzero(odd & new[:-1]), np.flatnonzero(odd & new[1:])
    part = np.searchsorted(rows, opens, "right") - 1
    return [(n, d, (a, b + 1, s)) for n, d, a, b, s in zip(*(x.tolist() for x in (part, doc[opens], at[opens], at[closes], state[opens])))]


def spans_of(texts: list[str], piece: int = PIECE, block: int = BLOCK) -> list[list[Span]]:
    """Spans of misread characters in texts of any length and number, in blocks of bounded size.

    A long text is read in pieces. Each ends at a character where the path is clean whatever follows, and the next begins
    there, with that character as its context, so the spans are those of the text as a whole. Where a piece has no such character, it is read again at twice the
    size; memory grows with the longest stretch that some state can read throughout.
    """
    out: list[list[Span]] = [[] for _ in texts]
    todo = [(i, 0, piece) for i in range(len(texts))]
    parts: list[Read] = []
    blocks: list[list[tuple[int, int, int]]] = []  # of each part: number, offset and first own place of its texts

    def run() -> None:
        for n, d, (a, b, s) in label(parts) if parts else []:
            i, shift, lead = blocks[n][d]
            if a >= lead and b <= parts[n].upto[d]:
                out[i].append((a + shift, b + shift, s))
        parts.clear()
        blocks.clear()

    while todo:
        held, later, size = [], [], 0
        for n, (i, offset, most) in enumerate(todo):
            part = texts[i][max(0, offset - 1) : offset + most]
            if held and size + len(part) > block:
                later = todo[n:]
                break
            held.append((i, offset, most, part))
            size += len(part)
        found = read([p for *_, p in held], [offset + most < len(texts[i]) for i, offset, most, _ in held])
        parts.append(found)
        blocks.append([(i, max(0, offset - 1), min(1, offset)) for i, offset, *_ in held])
        again = []
        for (i, offset, most, _), end in zip(held, found.upto):
            lead = min(1, offset)
            if end <= lead and offset + most < len(texts[i]):
                again.append((i, offset, 2 * most))
            elif offset - lead + end < len(texts[i]):
                again.append((i, offset - lead + end, piece))
        if sum(len(p.gain) for p in parts) > HELD:
            run()
        todo = again + later
    run()
    return [sorted(x) for x in out]


def inverse(text: str, spans: list[Span]) -> str:
    """Text with each span put through its state's inverse transform; a group that reaches over the end of a span is taken whole."""
    out, at = [], 0
    for a, b, s in spans:
        if a < at:
            continue
        while b < len(text) and text[b] >= "\x80" and STATES[s].was in ("utf-8", "shift_jis", "euc_jp"):
            b += 1
        if STATES[s].was == "shift_jis" and b < len(text):
            b += 1
        cp = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        value, _, _ = model().restored(cp, STATES[s])
        out += [text[at:a], value.astype(np.uint32).tobytes().decode("utf-32-le", "replace")]
        at = b
    return "".join([*out, text[at:]])


def examine(texts: list[str]) -> list[tuple[list[str], str] | None]:
    """For each text None if it is clean, else the encoding pairs found in it and the text restored as far as it can be.

    What was misread more than once is taken back step by step, until nothing is found any more or a text comes back that was
    there before. Lost characters stay, as the pair `lost`.
    """
    out: list[tuple[list[str], str] | None] = [None] * len(texts)
    todo = [i for i, t in enumerate(texts) if not t.isascii()]
    seen = {i: {texts[i]} for i in todo}
    while todo:
        now = [texts[i] if out[i] is None else out[i][1] for i in todo]
        again = []
        for i, text, spans in zip(todo, now, spans_of(now)):
            if not spans:
                continue
            names = out[i][0] if out[i] else []
            after = inverse(text, spans)
            out[i] = (names + [n for n in dict.fromkeys(STATES[s].name for _, _, s in spans) if n not in names], after)
            if after not in seen[i]:
                seen[i].add(after)
                again.append(i)
        todo = again
    for i, t in enumerate(texts):
        if LOST in t:
            names, text = out[i] or ([], t)
            out[i] = ([*names, "lost"], text)
    return out


def _examine(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                found = examine(b.column(1).to_pylist())
                hit = [i for i, x in enumerate(found) if x is not None]
                yield pa.record_batch(
                    {
                        "id": b.column(0).take(pa.array(hit, pa.int64())),
                        "encodings": pa.array([found[i][0] for i in hit], pa.list_(pa.string())),
                        "restored": pa.array([found[i][1] for i in hit], pa.string()),
                    }
                )

    return run


def garbled(df: DataFrame, id_col: str, text: str, rows: int = 2000) -> DataFrame:
    """(id_col, encodings, restored) of the rows whose text holds characters that came about by reading it with the wrong encoding.

    A hidden Markov model labels the characters (see garble_model); each labelled span is put through the inverse of its state. `encodings` names
    the pairs written>read; `lost` stands for replacement characters, which can't be restored. One narrow pass; only tables of fewer files than
    cores are spread first. Null and
    empty texts are clean; long texts are examined whole, in pieces; repeated rows give a row each; other columns don't matter.
    """
    part = df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    part = spread(part, "id")
    kind = part.schema["id"].dataType.simpleString()
    return part.mapInArrow(_examine(rows), f"id {kind}, encodings array<string>, restored string").withColumnRenamed("id", id_col)
