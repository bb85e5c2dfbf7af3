"""Choosing among the denotations of one text. No Spark inside."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True, slots=True)
class Denotation:
    begin: int
    end: int
    obj: str
    score: float | None
    string: str = ""
    label: str | None = None
    norm1: str | None = None
    norm2: str | None = None
    abbr_type: str | None = None

    def overlaps(self, other: Denotation) -> bool:
        return self.begin < other.end and other.begin < self.end


def ordered(found: list[Denotation]) -> list[Denotation]:
    """By begin, longer first, better first; then by identifier and label, so that ties come out the same each time."""
    return sorted(found, key=lambda d: (d.begin, -d.end, -d.score, d.obj, d.label or ""))


def consolidated(found: list[Denotation]) -> list[Denotation]:
    """Of overlapping denotations with one identifier the better one stays; of equal ones the first.

    found is ordered by begin, so only those that still reach beyond the current begin are looked at.
    """
    kept: dict[int, Denotation] = {}
    open_by_obj: dict[str, list[int]] = {}
    for i, d in enumerate(found):
        rivals = [j for j in open_by_obj.get(d.obj, []) if j in kept and kept[j].end > d.begin]
        over = [j for j in rivals if kept[j].overlaps(d)]
        beaten = []
        for j in over:
            if d.score <= kept[j].score:
                break
            beaten.append(j)
        else:
            kept[i] = d
            rivals.append(i)
        for j in beaten:
            del kept[j]
        open_by_obj[d.obj] = rivals
    return [kept[i] for i in sorted(kept)]


def without_crossings(found: list[Denotation]) -> list[Denotation]:
    """Where spans overlap without one holding the other, the better of the later one and all it crosses stays."""
    gone: set[int] = set()
    unfinished: list[int] = []
    for i, d in enumerate(found):
        unfinished = [j for j in unfinished if found[j].end > d.begin]
        crossed = [j for j in unfinished if found[j].end < d.end]
        if not crossed:
            unfinished.append(i)
        elif d.score > max(found[j].score for j in crossed):
            gone.update(crossed)
            unfinished = [j for j in unfinished if j not in crossed] + [i]
        else:
            gone.add(i)
    return [d for i, d in enumerate(found) if i not in gone]


def without_embedded(found: list[Denotation], longest: bool = True, superfluous: bool = False) -> list[Denotation]:
    """What stays of spans within spans.

    The chain of chosen spans around the current one is followed from the last chosen. In a chain with the same identifier the current one
    stays if it is better, and takes that one's place. Else, with longest, it stays only if it ties with the last chosen in span and score;
    without, if superfluous or at least as good as the innermost span around it.
    """
    chosen: list[int] = []
    around: dict[int, list[int]] = {}
    for i, d in enumerate(found):
        if not chosen:
            chosen.append(i)
            continue
        last = chosen[-1]
        chain = around.get(last)
        if d.begin < found[last].end:
            chain = [*(chain or []), last]
        elif chain is not None:
            inner = max((k for k, h in enumerate(chain) if found[h].end >= d.end), default=None)
            chain = None if inner is None else chain[: inner + 1]
        if chain is None:
            chosen.append(i)
            continue
        same = next((h for h in chain if found[h].obj == d.obj), None)
        if same is not None:
            stays = d.score > found[same].score
            if stays:
                chosen = [h for h in chosen if h != same]
                chain = [h for h in chain if h != same]
        elif longest:
            stays = (d.begin, d.end, d.score) == (found[last].begin, found[last].end, found[last].score)
        else:
            stays = superfluous or d.score >= found[chain[-1]].score
        if stays:
            chosen.append(i)
            if chain:
                around[i] = chain
    return [found[i] for i in chosen]


def resolve(found: list[Denotation], longest: bool = True, superfluous: bool = False) -> list[Denotation]:
    return without_embedded(without_crossings(consolidated(ordered(found))), longest, superfluous)


def merged(found: list[Denotation], abbreviations: list[Denotation]) -> list[Denotation]:
    """Denotations and those of abbreviations, one per span and identifier, the former first; by begin, longer first."""
    first: dict[tuple[int, int, str], Denotation] = {}
    for d in [*found, *abbreviations]:
        first.setdefault((d.begin, d.end, d.obj), d)
    return sorted(first.values(), key=lambda d: (d.begin, -d.end))
