"""Abbreviations that a text defines in parentheses after a term. No Spark inside."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

from termforge.functions.resolve import Denotation
from termforge.functions.text import Token, abbreviation_type

LONGEST = 4


def _closing(toks: list[Token], first: int, level: int) -> int | None:
    """Last token of the parenthesis that begins with token `first`, if it ends within LONGEST tokens."""
    last = first
    while last - first < LONGEST - 1 and last + 1 < len(toks) and toks[last + 1].level > level:
        last += 1
    return last if last == len(toks) - 1 or toks[last + 1].level == level else None


def local_abbreviations(text: str, toks: list[Token], found: list[Denotation]) -> list[Denotation]:
    """Denotations of every occurrence of each abbreviation that the text defines for one of the found denotations."""
    begins, ends = [t.begin for t in toks], [t.end for t in toks]
    single: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(toks):
        single[text[t.begin : t.end]].append(i)
    out = []
    for d in found:
        before = bisect_right(begins, d.end) - 1 if not toks or d.end not in ends else bisect_left(ends, d.end)
        before = min(before, len(toks) - 1)
        if before < 0 or before + 1 >= len(toks) or toks[before + 1].level <= toks[before].level:
            continue
        first = before + 1
        last = _closing(toks, first, toks[before].level)
        if last is None:
            continue
        short = text[toks[first].begin : toks[last].end]
        if text[toks[last].end : toks[last].end + 2] == "))":
            short += ")"
        kind = abbreviation_type(short, d.string)
        if kind is None:
            continue
        head = text[toks[first].begin : toks[first].end]
        for i in single[head]:
            j = i + last - first
            if j >= len(toks):
                continue
            begin, end = toks[i].begin, toks[j].end
            if last > first:
                begin -= short[0] == "(" and toks[i].opens
                outer = toks[i - 1].level if i else 0
                end += short[-1] == ")" and (j == len(toks) - 1 or toks[j + 1].level == outer)
            if text[begin:end] == short:
                out.append(Denotation(begin, end, d.obj, None, short, abbr_type=kind))
    return out
