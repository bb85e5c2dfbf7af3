"""The English Snowball stemmer (Porter2), from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
V, C = "[aeiouy]", "[^aeiouy]"
R1 = re.compile(f"{V}{C}")
SHORT_END = re.compile(f"(?:{C}{V}[^aeiouywxY]|^{V}{C})$")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words with a stem of their own, words that stay, and beginnings after which region 1 starts.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STARTS = ("gener", "commun", "arsen")
# Suffixes of steps 2, 3 and 4, and what replaces them in region 1, 1 and 2.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
BY_LENGTH = {n: sorted(t, key=len, reverse=True) for n, t in (("2", list(STEP2)), ("3", list(STEP3)), ("4", STEP4))}


def _regions(w: str) -> tuple[int, int]:
    start = next((len(s) for s in STARTS if w.startswith(s)), None)
    if start is None:
        m = R1.search(w)
        start = m.end() if m else len(w)
    m = R1.search(w, start)
    return start, m.end() if m else len(w)


def _suffix(w: str, step: str) -> str | None:
    return next((s for s in BY_LENGTH[step] if w.endswith(s)), None)


def _has_vowel(s: str) -> bool:
    return any(c in VOWELS for c in s)


def _step1(w: str, r1: int) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    for s in ("eedly", "eed"):
        if w.endswith(s):
            w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                stem = w[: -len(s)]
                if _has_vowel(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        w = stem + "e"
                    elif stem.endswith(DOUBLES):
                        w = stem[:-1]
                    elif len(stem) <= r1 and SHORT_END.search(stem):
                        w = stem + "e"
                    else:
                        w = stem
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-cased word; words of one or two letters and words with other than a-z and ' stay."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'").replace("’", "'")
    if w in OWN:
        return OWN[w]
    w = re.sub(f"(?:^y|(?<={V})y)", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    w = _step1(w, r1)
    if w in STAY:
        return w
    s = _suffix(w, "2")
    if s and len(w) - len(s) >= r1:
        left = w[: -len(s)]
        if s == "ogi":
            w = left + "og" if left.endswith("l") else w
        elif s == "li":
            w = left if left[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = left + STEP2[s]
    s = _suffix(w, "3")
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + STEP3[s]
    s = _suffix(w, "4")
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
