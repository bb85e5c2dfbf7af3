"""Text kernels: folding, tokens, norms, sentence breaks, parenthesis levels, candidate spans. No Spark inside."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import regex

from termforge.functions.porter2 import stem
from termforge.functions.stopwords import STEM_STOPS

# Letters that folding replaces though they don't decompose.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n"})
# Kana voicing marks, which folding keeps.
VOICED = "\u3099\u309a"
STOPS = frozenset(STEM_STOPS)
_WORD = r"[[\w\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}ー]]"
TOKEN = regex.compile(
    rf"(?V1)[\p{{Katakana}}ー]+|\p{{Han}}+|\p{{Hiragana}}+|{_WORD}+(?:(?:(?<=\p{{L}})[.'’](?=\p{{L}})|(?<=\p{{Nd}})[.,;'](?=\p{{Nd}})){_WORD}+)*"
)
BREAK = re.compile(r"[a-z0-9][.!?](\s+)(?=[A-Z])|(\n)")


@lru_cache(maxsize=200_000)
def fold(s: str) -> str:
    """Case, accents and width away."""
    if s.isascii():
        return s.lower()
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if c in VOICED or unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFKC", plain.casefold()).translate(PLAIN)


@dataclass(slots=True)
class Token:
    begin: int
    end: int
    norm1: str
    norm2: str  # empty for a stop word
    level: int = 0
    opens: bool = False
    closes: bool = False


@lru_cache(maxsize=200_000)
def norm2_of(folded: str) -> str:
    s = stem(folded)
    return "" if s in STOPS else s


def tokens(text: str) -> list[Token]:
    """Words with offsets in code points; braces count as parentheses, which split words anyway."""
    return [Token(m.start(), m.end(), f := fold(m.group()), norm2_of(f)) for m in TOKEN.finditer(text)]


def normalize1(text: str | None) -> str | None:
    """Folded words joined without anything between them; null stays null."""
    return None if text is None else "".join(fold(m) for m in TOKEN.findall(text))


def normalize2(text: str | None) -> str | None:
    """Folded and stemmed words without stop words, joined; empty if all are stop words."""
    return None if text is None else "".join(norm2_of(fold(m)) for m in TOKEN.findall(text))


def norms(text: str) -> tuple[str, str]:
    """normalize1() and normalize2() together."""
    folded = [fold(m) for m in TOKEN.findall(text)]
    return "".join(folded), "".join(map(norm2_of, folded))


def sentence_breaks(text: str) -> list[int]:
    """Where sentences end: at white space between a lower-case letter or digit with a full stop and a capital, and at line feeds."""
    return [m.start(1) if m.group(1) is not None else m.start(2) for m in BREAK.finditer(text)]


def crosses(breaks: list[int], begin: int, end: int) -> bool:
    return any(begin < p < end for p in breaks)


class _Breaks:
    """Whether a break lies strictly between two offsets, by bisection."""

    def __init__(self, breaks: list[int]) -> None:
        self.at = breaks

    def between(self, begin: int, end: int) -> bool:
        i = bisect_right(self.at, begin)
        return i < len(self.at) and self.at[i] < end


def crossings(text: str) -> int | None:
    """Pairs of neighbouring words with a sentence break between the begin of the one and the end of the other; None for a text of fewer than two words.

    A break is white space, which no word holds, so the pairs are the gaps between the stretches from break to break that have a word.
    """
    at = [0, *sentence_breaks(text), len(text)]
    n = sum(TOKEN.search(text, a, z) is not None for a, z in zip(at, at[1:]))
    return n - 1 if n > 1 or len(list(islice(TOKEN.finditer(text), 2))) > 1 else None


def add_levels(toks: list[Token], text: str, breaks: list[int]) -> None:
    """Depth of parentheses before each token, never below 0, starting anew after a sentence break; and whether one touches it."""
    if "(" not in text and ")" not in text:
        return
    b, level, end = _Breaks(breaks), 0, 0
    for i, t in enumerate(toks):
        if i and b.between(end, t.begin):
            level = 0
        gap = text[end : t.begin]
        level = max(0, level + gap.count("(") - gap.count(")"))
        t.level, end = level, t.end
        t.opens = t.begin > 0 and text[t.begin - 1] == "("
        t.closes = text[t.end : t.end + 1] == ")"


class Span(NamedTuple):
    begin: int
    end: int
    first: int
    last: int
    norm1: str
    norm2: str


@dataclass(frozen=True)
class SpanRules:
    shortest: int = 1
    longest: int = 6
    no_term: frozenset[str] = frozenset()
    no_begin: frozenset[str] = frozenset()
    no_end: frozenset[str] = frozenset()


def _fit(a: Token, z: Token) -> tuple[int, int] | str:
    """Offsets of the span from token a to z with the parenthesis that completes it, or what to do instead."""
    depth = a.level - z.level
    if depth == 0:
        return a.begin, z.end
    if depth == -1 and z.closes:
        return a.begin, z.end + 1
    if depth == 1:
        return (a.begin - 1, z.end) if a.opens else "stop"
    return "skip"


def candidate_spans(toks: list[Token], breaks: list[int], rules: SpanRules, wanted: Callable[[str], bool] | None = None) -> Iterator[Span]:
    """Spans of tokens that may be terms: within a sentence, without stop words at the ends, in balanced parentheses.

    wanted tells of a norm2 whether it is of use; spans of others are left out.
    """
    n = len(toks)
    # sentence of each token's begin and end; a span crosses a break if one lies strictly between them
    begins = [bisect_right(breaks, t.begin) for t in toks]
    ends = [bisect_left(breaks, t.end) for t in toks]
    stops = [t.norm1 in rules.no_term for t in toks]
    for i in range(n - rules.shortest + 1):
        a = toks[i]
        if stops[i] or a.norm1 in rules.no_begin:
            continue
        norm1 = "".join(t.norm1 for t in toks[i : i + rules.shortest - 1])
        norm2 = "".join(t.norm2 for t in toks[i : i + rules.shortest - 1])
        for j in range(i + rules.shortest - 1, min(i + rules.longest, n)):
            z = toks[j]
            if stops[j] or ends[j] > begins[i]:
                break
            norm1 += z.norm1
            norm2 += z.norm2
            if z.norm1 in rules.no_end:
                continue
            at = (a.begin, z.end) if a.level == z.level else _fit(a, z)
            if at == "stop":
                break
            if at == "skip" or not norm2 or (wanted is not None and not wanted(norm2)):
                continue
            yield Span(at[0], at[1], i, j, norm1, norm2)


def abbreviation_type(short: str, full: str) -> str | None:
    """How short abbreviates full: by initials or by capitals and digits (regular), by its letters (free), or not at all."""
    low = short.lower()
    initials = "".join(w[0] for w in re.split(r"[- ]", full) if w).lower()
    capitals = "".join(re.findall(r"[0-9A-Z]", full)).lower()
    if low in (initials, capitals):
        return "regAbbreviation"
    if low[:1] == full[:1].lower() and set(re.findall(r"[0-9a-z]", low)) <= set(re.findall(r"[0-9a-z]", full.lower())):
        return "freeAbbreviation"
    return None


def worth_embedding(span: str) -> bool:
    return len(span) >= 3 and not re.fullmatch(r"[\d.\-+,\s]+", span)


def simple_tokens(text: str) -> list[tuple[str, int, int]]:
    """Pieces between white space, symbols being pieces of their own."""
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+|[^\w\s]|_", text)]


def decapitalize(text: str) -> str:
    return re.sub(r"(^| )[A-Z][a-z ]", lambda m: m.group().lower(), text)
