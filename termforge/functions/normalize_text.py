"""A configurable normalisation that keeps what lies between words."""

from __future__ import annotations

from termforge.functions.porter2 import stem
from termforge.functions.text import simple_tokens


def normalize_str(text: str, stems: bool = False, lowercase: bool = False, hyphens_to_spaces: bool = False) -> str:
    """The text with its words stemmed, in lower case, or with spaces for hyphens; gaps stay as they are."""
    out, at = [], 0
    for piece, begin, end in simple_tokens(text):
        out.append(text[at:begin])
        word = piece.lower() if lowercase else piece
        if hyphens_to_spaces and piece == "-":
            word = " "
        out.append(stem(word.lower()) if stems and word.isalpha() else word)
        at = end
    return "".join([*out, text[at:]])
