"""A hidden Markov model of texts read with the wrong character encoding: one clean state, and one per pair of encodings."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

# Classes of characters, by which the model tells how usual a character is between its neighbours.
CLASSES = (
    "space punct digit lower upper low_accent up_accent cyr_low cyr_up cyr_other greek cjk cjk_punct open close apostrophe dash relation degree raised "
    "micro sign weird box control lost emoji hard_space mark invisible rare dots either"
).split()
ID = {name: i for i, name in enumerate(CLASSES)}
N = len(CLASSES)

# Accented letters at home in widely used Latin scripts; others count as rare.
HOME_LOW = "àáâãäåæçèéêëìíîïñòóôõöøùúûüœß"
HOME_UP = "ÀÁÂÃÄÅÆÇÈÉÊËÍÎÑÓÔÕÖØÚÜŒ"
# Russian letters by falling frequency.
CYRILLIC_ORDER = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
# Signs by use.
SIGNS = {
    "either": "“‘", "open": "„«‚¿¡", "close": "”»", "apostrophe": "’", "dash": "–—", "dots": "…•", "relation": "±≤≥≈×≠", "degree": "°", "raised": "²³¹ªº⁵", "micro": "µ",
    "sign": "©®™§€£½¼¾№¥¢", "cjk_punct": "、。「」『』・※〜（）％，．：；！？", "hard_space": "    ", "invisible": "­﻿​‌‍⁠", "lost": "�",
}


def _class_of(cp: int) -> str:
    c = chr(cp)
    for name, chars in SIGNS.items():
        if c in chars:
            return name
    if cp < 0x80:
        return "space" if c.isspace() or cp < 32 else "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "punct"
    if c == "\u0085" or 0x80 <= cp < 0xA0 or 0xE000 <= cp < 0xF900:
        return "control"
    if 0x2500 <= cp < 0x25A0:
        return "box"
    if 0x400 <= cp < 0x530:
        return ("cyr_low" if c.islower() else "cyr_up") if c.lower() in CYRILLIC_ORDER else "cyr_other"
    if 0x370 <= cp < 0x400:
        return "greek" if c.isalpha() else "rare"
    if 0x3000 <= cp < 0x3040 or 0xFF00 <= cp < 0xFF66:
        return "cjk_punct"
    if 0x3040 <= cp < 0x3100 or 0x4E00 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0xFF66 <= cp < 0xFFA0:
        return "cjk"
    kind = unicodedata.category(c)
    if cp < 0x250 and kind in ("Ll", "Lu"):
        return "low_accent" if kind == "Ll" else "up_accent"
    if kind.startswith("M"):
        return "mark" if 0x300 <= cp < 0x370 or 0x3099 <= cp <= 0x309A else "rare"
    if kind in ("Cn", "Cs", "Co"):
        return "control"
    if kind.startswith("Z"):
        return "hard_space"
    if 0x2600 <= cp < 0x27C0:
        return "emoji"
    if kind[0] == "L" and not 0x2B0 <= cp < 0x300 and cp not in (0x192, 0xFB01, 0xFB02):
        return "rare"
    return "weird"


def _usual(left: str, c: str, right: str) -> float:
    """How usual class c is between its neighbours: about the log of its probability against that of a usual place."""
    low, up = ("lower", "low_accent"), ("upper", "up_accent")
    latin = low + up
    cyr = ("cyr_low", "cyr_up")
    odd = ("weird", "box", "control", "sign", "degree", "raised", "relation", "cyr_other", "rare", "micro")
    near_odd = 3.0 * ((left in odd) + (right in odd))
    l_lat, r_lat = left in latin, right in latin
    alone = ("space", "punct", "apostrophe", "cjk_punct")
    if c == "low_accent":
        s = 0.0 if l_lat or right in low or (left in alone and right in alone) else -1.5
        s -= 4.0 * (left == "digit") + 3.0 * (right == "digit") + 4.0 * (left in up and right in up)
        return s - near_odd - 3.0 * (right == "open") - 2.0 * (right == "either" and left not in low) - 2.0 * ((left in cyr) + (right in cyr))
    if c == "up_accent":
        if left in low:
            s = -6.0
        elif left in up:
            s = -5.5 if right in low else -0.5
        else:
            s = 0.0 if right in low or (left in alone and right in alone) else -0.3 if right in up else -1.5
        s -= 4.0 * (left == "digit") + 3.0 * (right == "digit")
        return s - near_odd - 3.0 * (right in ("open", "either", "dots", "dash")) - 1.5 * (right in ("close", "hard_space", "apostrophe")) - 2.0 * ((left in cyr) + (right in cyr))
    if c in cyr:
        s = -5.0 if c == "cyr_up" and left == "cyr_low" else -1.2 if c == "cyr_up" and left == "cyr_up" else 0.0
        s -= 4.0 * (l_lat + r_lat) + near_odd + 2.0 * (left == "digit") + 1.0 * (right == "digit") + 1.5 * (left not in cyr and right not in cyr)
        return s - 2.0 * (c == "cyr_up" and right in ("open", "either", "dash", "dots")) - 1.0 * (c == "cyr_up" and right in ("close", "hard_space", "apostrophe"))
    if c == "cyr_other":
        return -5.0
    if c == "greek":
        return -2.0 * (l_lat + r_lat) - 1.0 * (left == "greek") - near_odd - 2.0 * ((left in cyr) + (right in cyr))
    if c == "cjk":
        wide = ("cjk", "cjk_punct")
        s = 0.0 if left in wide or right in wide else -2.5
        return s - near_odd * 0.7 - 4.0 * (left in low or left == "up_accent") - 4.0 * (right in low or right == "up_accent")
    if c == "cjk_punct":
        return -near_odd * 0.5
    if c == "open":
        return -5.0 * (l_lat or left in cyr or left == "digit") - near_odd - 1.0 * (right == "punct") - 1.5 * (right in ("close", "dash"))
    if c == "either":
        # opens in English, closes in German
        opens = -5.0 * (l_lat or left in cyr or left == "digit")
        closes = -5.0 * (r_lat or right in cyr or right == "digit") - 2.0 * (left == "space")
        return max(opens, closes) - near_odd - 1.5 * (right in ("close", "dash"))
    if c == "close":
        return -5.0 * (r_lat or right in cyr) - near_odd - 1.0 * (left == "open")
    if c == "apostrophe":
        s = 0.0 if (l_lat and r_lat) or left in cyr or (l_lat and right in ("space", "punct")) else -2.0
        return s - 3.0 * (left == "space" and r_lat) - near_odd
    if c == "dash":
        s = 0.0 if (left in ("space", "hard_space") and right in ("space", "hard_space")) or (left == right == "digit") else -1.5
        return s - 2.5 * (l_lat or left in cyr) * (r_lat or right in cyr) - 1.0 * (l_lat + r_lat) - near_odd
    if c == "dots":
        return (0.0 if right in ("space", "punct", "close") or left == "space" else -2.5) - 2.0 * (r_lat and l_lat) - near_odd
    if c == "relation":
        return -3.5 * (l_lat + r_lat) - near_odd - 2.0 * ((left in cyr) + (right in cyr))
    if c == "degree":
        s = 0.0 if left in ("digit", "space", "hard_space") and right in ("upper", "space", "punct", "cjk_punct", "digit", "cyr_up") else -2.5
        return s - 3.0 * (right in low) - 2.0 * l_lat - 3.0 * (left == "up_accent") - near_odd
    if c == "raised":
        s = 0.0 if left in ("digit", "lower", "upper", "punct") and right in ("space", "punct", "cjk_punct") else -2.5
        return s - 3.0 * (left == "space") - 3.0 * r_lat - 2.0 * (left in ("low_accent", "up_accent")) - near_odd
    if c == "micro":
        s = 0.0 if left in ("digit", "space", "hard_space", "punct", "cjk_punct") and right in low + up else -3.0
        return s - 3.0 * l_lat - near_odd
    if c == "sign":
        s = -1.0 if left in ("space", "punct", "digit", "cjk_punct") or l_lat else -2.0
        return s - 2.0 * (l_lat or left in cyr) - 3.0 * (r_lat or right in cyr) - near_odd
    if c == "weird":
        return -3.0 - 1.5 * ((l_lat or left in cyr) + (r_lat or right in cyr)) - 0.5 * near_odd
    if c == "rare":
        return -1.0 if "rare" in (left, right) else -6.0
    if c == "hard_space":
        return -1.5 * (l_lat and r_lat) - 2.0 * (left == "up_accent") - near_odd
    if c == "mark":
        return -1.0 if l_lat or left in ("cjk", "mark") else -4.0
    return {"box": -7.0, "control": -9.0, "lost": -20.0, "emoji": -0.5, "invisible": -0.5}.get(c, 0.0)


@dataclass(frozen=True)
class State:
    """Text written in encoding `was` and read in encoding `seen`, `times` times over."""

    was: str
    seen: str
    times: int = 1

    @property
    def name(self) -> str:
        return f"{self.was}>{self.seen}" + f"*{self.times}" * (self.times > 1)


# The pairs of encodings that are told apart.
PAIRS = {
    "utf-8": ["cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251", "koi8-r", "cp1250", "cp866", "iso8859-15", "mac-cyrillic"],
    "cp1252": ["mac-roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "latin-1"],
    "mac-roman": ["cp1252", "latin-1"],
    "cp437": ["cp1252", "latin-1"],
    "cp850": ["cp1252", "latin-1"],
    "cp1251": ["cp1252", "latin-1", "koi8-r", "cp866", "mac-roman", "cp1250"],
    "koi8-r": ["cp1251", "cp1252", "latin-1", "cp866"],
    "cp866": ["cp1251", "cp1252", "latin-1", "koi8-r"],
    "shift_jis": ["cp1252", "latin-1", "mac-roman"],
    "euc_jp": ["cp1252", "latin-1"],
}
STATES = [State(a, b) for a, bs in PAIRS.items() for b in bs] + [State("utf-8", b, n) for b, n in (("cp1252", 2), ("latin-1", 2), ("mac-roman", 2), ("cp1252", 3), ("latin-1", 3))]
ENTER_MULTI, ENTER_SINGLE, LEAVE, WRONG = 4.0, 5.0, 0.3, -9.0
#: What a decoded character costs, and what it tells that several characters happen to make one.
READ, GROUP = 0.15, 1.5


def to_byte(encoding: str) -> np.ndarray:
    """Byte of each character below U+10000 in a one-byte encoding, -1 where it has none; undefined bytes stand for the control of their number."""
    table = np.full(0x10000, -1, np.int16)
    for b in range(256):
        try:
            c = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            c = b
        table[c] = b
    if encoding == "cp1252":
        for b in range(0x80, 0xA0):
            if table[b] < 0:
                table[b] = b
    return table


def from_byte(encoding: str) -> np.ndarray:
    out = np.zeros(256, np.int32)
    for b in range(256):
        try:
            out[b] = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out[b] = 0xFFFD
    return out


def _double_table(encoding: str) -> np.ndarray:
    """Character of each pair of bytes, 0 where there is none."""
    out = np.zeros(0x10000, np.int32)
    for hi in range(0x80, 0x100):
        for lo in range(0x40, 0x100):
            try:
                s = bytes([hi, lo]).decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(s) == 1:
                out[hi << 8 | lo] = ord(s)
    return out


class Model:
    """Tables of the model, built once per worker."""

    def __init__(self) -> None:
        self.cls = np.array([ID[_class_of(c)] if not 0xD800 <= c < 0xE000 else ID["control"] for c in range(0x10000)], np.uint8)
        self.table = np.array([[[_usual(a, c, b) for b in CLASSES] for c in CLASSES] for a in CLASSES], np.float32)
        own = np.zeros(0x10000, np.float32)
        for c in range(0xA0, 0x250):
            if self.cls[c] in (ID["low_accent"], ID["up_accent"]) and chr(c) not in HOME_LOW + HOME_UP:
                own[c] = -3.0 if self.cls[c] == ID["low_accent"] else -2.5
        own[0x4E00:0xA000] = -1.5
        own[0xFF61:0xFFA0] = -2.0
        for i, c in enumerate(CYRILLIC_ORDER):
            own[ord(c)] = own[ord(c.upper())] = 0.8 - 2.6 * i / len(CYRILLIC_ORDER)
        self.own = own
        self.bytes_of = {e: to_byte(e) for e in {s.seen for s in STATES}}
        self.chars_of = {e: from_byte(e) for e in {s.was for s in STATES} if e not in ("utf-8", "shift_jis", "euc_jp")}
        self.legible = np.any([b >= 0x80 for b in self.bytes_of.values()], axis=0)
        self.singles: dict[str, tuple] = {}
        self.pairs_of = {e: _double_table(e) for e in ("shift_jis", "euc_jp")}

    def classes(self, cp: np.ndarray) -> np.ndarray:
        return np.where(cp < 0x10000, self.cls[np.minimum(cp, 0xFFFF)], ID["emoji"])

    def usual(self, cp: np.ndarray) -> np.ndarray:
        """Score of every character between its neighbours; cp begins and ends with a space."""
        k = self.classes(cp)
        s = np.zeros(len(cp), np.float32)
        s[1:-1] = self._between(k[:-2], k[1:-1], k[2:])
        s += self.own[np.minimum(cp, 0xFFFF)]
        s[cp < 0x80] = 0
        s[cp >= 0x10000] = np.where((cp[cp >= 0x10000] >= 0x1F000) & (cp[cp >= 0x10000] < 0x1FB00), -0.5, -6.0)
        return s

    def _between(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.table.ravel()[(a.astype(np.int32) * N + b) * N + c]

    def _pairs(self, cp: np.ndarray, b: np.ndarray, was: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of pairs of bytes; whether a pair begins here: pairs are taken from the left within each run; half-width kana are single."""
        b1 = np.append(b[1:], -1)
        char = self.pairs_of[was][np.where((b >= 0x80) & (b1 >= 0x40), b << 8 | b1, 0)]
        at = np.flatnonzero((char > 0) & (cp >= 0x80))
        keep, half = np.zeros(len(cp), bool), np.zeros(len(cp), bool)
        if len(at):
            opens = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], at, 0))
            keep[at[(at - opens) % 2 == 0]] = True
        if was == "shift_jis":
            half = (b >= 0xA1) & (b < 0xE0) & ~keep & ~np.r_[False, keep[:-1]] & (cp >= 0x80)
        return char, keep, half

    def decode(self, cp: np.ndarray, was: str, seen: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text as it was: its characters, the position in cp where each begins, and whether it was decoded (else it stands as it is)."""
        b = np.where(cp < 0x10000, self.bytes_of[seen][np.minimum(cp, 0xFFFF)], -1).astype(np.int32)
        n = len(cp)
        if was in self.chars_of:
            ok = (b >= 0x80) & (cp >= 0x80)
            out = np.where(ok, self.chars_of[was][np.maximum(b, 0)], cp)
            return out.astype(np.int32), np.arange(n), ok & (out != 0xFFFD)
        size, value = np.ones(n, np.int32), cp.astype(np.int32).copy()
        single = np.zeros(n, bool)
        if was == "utf-8":
            pad = np.concatenate([b, np.full(4, -1, np.int32)])
            b1, b2, b3 = pad[1 : n + 1], pad[2 : n + 2], pad[3 : n + 3]
            cont = lambda x: (x >= 0x80) & (x < 0xC0)
            two = (b >= 0xC2) & (b < 0xE0) & cont(b1)
            three = (b >= 0xE0) & (b < 0xF0) & cont(b1) & cont(b2)
            four = (b >= 0xF0) & (b < 0xF5) & cont(b1) & cont(b2) & cont(b3)
            v3 = (b & 15) << 12 | (b1 & 63) << 6 | b2 & 63
            three &= (v3 >= 0x800) & ~((v3 >= 0xD800) & (v3 < 0xE000))
            v4 = (b & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63
            four &= (v4 >= 0x10000) & (v4 < 0x110000)
            for mask, v, k in ((two, (b & 31) << 6 | b1 & 63, 2), (three, v3, 3), (four, v4, 4)):
                value[mask], size[mask] = v[mask], k
        else:
            char, keep, single = self._pairs(cp, b, was)
            value[keep], size[keep] = char[keep], 2
            value[single] = 0xFF61 + b[single] - 0xA1
        done = (size > 1) | single
        inside = np.zeros(n + 4, bool)
        for k in (1, 2, 3):
            inside[np.flatnonzero(size > k) + k] = True
        at = np.flatnonzero(~inside[:n])
        return value[at], at, done[at]

    def restored(self, cp: np.ndarray, s: State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, at, done = self.decode(cp, s.was, s.seen)
        for _ in range(s.times - 1):
            v2, a2, d2 = self.decode(value, s.was, s.seen)
            # only what was decoded each time counts
            first = np.add.reduceat(done.astype(np.int64), a2) if len(a2) else np.zeros(0)
            value, done, at = v2, d2 & (first > 0), at[a2]
        return value, at, done

    def _readable(self, cp: np.ndarray, s: State) -> np.ndarray:
        """Where a group of several characters may begin that the state's encoding can read, with what lies around it; nothing else needs decoding."""
        b = self.bytes_of[s.seen][np.minimum(cp, 0xFFFF)]
        after = np.append(b[1:], -1)
        if s.was == "utf-8":
            lead = (b >= 0xC2) & (b < 0xF5) & (after >= 0x80) & (after < 0xC0)
        else:
            lead = b >= 0x80
        at, reach, n = np.flatnonzero(lead), 8 * s.times, len(cp)
        around = np.bincount(np.maximum(at - reach, 0), minlength=n + 1) - np.bincount(np.minimum(at + reach + 1, n), minlength=n + 1)
        return np.flatnonzero(np.cumsum(around[:n]) > 0)

    def gains(self, cp: np.ndarray) -> np.ndarray:
        """For every character beyond ASCII a row, a column per state: what reading it as that state tells adds to its usualness.

        A group's score counts at its first character. cp begins and ends with a space.
        """
        raw = self.usual(cp)
        odd = np.flatnonzero(cp >= 0x80)
        out = np.full((len(STATES), len(odd)), WRONG, np.float32)
        if not len(odd):
            return out.T
        row = np.cumsum(cp >= 0x80) - 1
        low, big = np.minimum(cp, 0xFFFF), cp >= 0x10000
        for i, s in enumerate(STATES):
            if s.was in self.chars_of:  # character by character
                k, own, read = self._single(s)
                ok = read[low[odd]] & ~big[odd]
                k = np.where(big, ID["emoji"], k[low])
                o = odd[ok]
                out[i, ok] = self._between(k[o - 1], k[o], k[o + 1]) + own[low[o]] - raw[o] - READ
                continue
            part = self._readable(cp, s)
            if not len(part):
                continue
            value, at, done = self.restored(cp[part], s)
            score = self.usual(value)
            end = np.append(at[1:], len(part))
            gain = score - raw[part[at]] - READ + GROUP * (end - at > 1)
            hit = done & (cp[part[at]] >= 0x80)
            covered = np.repeat(done, end - at)
            covered[at] = False
            covered &= cp[part] >= 0x80
            out[i, row[part[covered]]] = -raw[part[covered]]
            out[i, row[part[at[hit]]]] = gain[hit]
        return np.ascontiguousarray(out.T)

    def _single(self, s: State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a state of single bytes, by character: class and own score of what it stands for, and whether it stands for anything."""
        if s.name not in self.singles:
            every = np.arange(0x10000, dtype=np.int32)
            value, _, done = self.decode(every, s.was, s.seen)
            self.singles[s.name] = (self.cls[value], np.where(value < 0x80, 0, self.own[value]).astype(np.float32), done)
        return self.singles[s.name]
