"""Request parameters as typed values."""

from __future__ import annotations

import re

from termforge.operators.annotate import Options


def to_boolean(value: str | bool | None, default: bool = False) -> bool:
    if value is None:
        return default
    return value if isinstance(value, bool) else value.strip() in ("true", "1")


def _number(value, kind):
    try:
        return kind(str(value).strip())
    except ValueError:
        return None


def to_integer(value: str | int | None) -> int | None:
    return None if value is None else _number(value, int)


def to_float(value: str | float | None) -> float | None:
    return None if value is None else _number(value, float)


def to_array(value: str | list | None) -> list[str]:
    """Parts between line ends, tabs, bars and commas, trimmed; a list stays."""
    if value is None:
        return []
    parts = value if isinstance(value, list) else re.split(r"[\n\t\r|,]+", value)
    return [p.strip() for p in parts if p.strip()]


def body_lines(body: str) -> list[str]:
    return [p.strip() for p in re.split(r"[\n,]", body) if p.strip()]


def annotation_options(params: dict) -> Options:
    """Options of an annotation request; absent ones keep the annotator's own defaults."""
    return Options(
        tokens_len_min=to_integer(params.get("tokens_len_min")),
        tokens_len_max=to_integer(params.get("tokens_len_max")),
        threshold=to_float(params.get("threshold")),
        semantic_threshold=to_float(params.get("semantic_threshold")),
        use_ngram_similarity=to_boolean(params.get("use_ngram_similarity")),
        abbreviation=to_boolean(params.get("abbreviation"), True),
        longest=to_boolean(params.get("longest"), True),
        superfluous=to_boolean(params.get("superfluous")),
        verbose=to_boolean(params.get("verbose")),
    )
