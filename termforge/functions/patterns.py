"""Regular expressions of pattern dictionaries, which are written in another dialect."""

from __future__ import annotations

from functools import lru_cache

import regex


@lru_cache(maxsize=10_000)
def compiled(expression: str) -> regex.Pattern[str]:
    """The expression as this engine's: hex digits and ends of text are rewritten; ^ and $ are those of lines. A ValueError if it can't be used."""
    e = expression.replace(r"\h", "[0-9a-fA-F]").replace(r"\Z", r"(?=\n?\Z)").replace(r"\z", r"\Z")
    try:
        return regex.compile(e, regex.MULTILINE | regex.VERSION0)
    except regex.error as err:
        raise ValueError(f"pattern can't be used: {expression}: {err}") from err


def usable(expression: str) -> bool:
    try:
        compiled(expression)
    except ValueError:
        return False
    return True


def matches(text: str, expression: str) -> list[tuple[int, int]]:
    """Offsets of all matches that don't overlap; empty ones are left out."""
    return [m.span() for m in compiled(expression).finditer(text) if m.end() > m.start()]
