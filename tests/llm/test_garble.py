import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termforge.llm import garble as g
from termforge.llm.garble_model import CLASSES, STATES, to_byte

CLEAN = [
    "ATENÇÃO: a infecção por myool não alterou A REGIÃO afetada (57.5 µg/mL). Nível Â: 13.5 Å.",
    "D’après l’étude, une lésion liée à « bronchopraxol » – déjà décrit. À l’inverse, rien.",
    "Außerdem ähnelte „enterojolin“ keiner größeren Störung bei 9 °C – wie üblich.",
    "El niño con daño, según el análisis: ¿Por qué? 52 % de los niños. ½ dose?",
    "Через 14 дней лечение препаратом вызывает «повышение» риска — как обычно. № 5",
    "一方、ネスヒゲコの投与により有意に回復を示した（22％）。※参照。",
    "As the patient’s chart shows, the TV97 (“XSK29”) rose (p ≤ 0.019) — see α-globin, 5 ± 2 at 10 °C… ¯\\_(ツ)_/¯ 😀 thx 🙏",
    "﻿Plain text, x² and 5ª.",
    "",
    "   ",
]


def misread(text, was, seen):
    return "".join(bytes([b]).decode(seen, "strict") if not (seen == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else chr(b) for b in text.encode(was))


def test_clean_stays():
    assert g.examine(CLEAN) == [None] * len(CLEAN)


@pytest.mark.parametrize("was,seen", [("utf-8", s) for s in ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "koi8-r")])
def test_utf8_round_trip(was, seen):
    texts = [t for t in CLEAN[:7] if "😀" not in t]
    out = g.examine([misread(t, was, seen) for t in texts])
    assert all(x is not None for x in out)
    assert sum(x[1] == t for x, t in zip(out, texts)) >= len(texts) - 1


def test_single_byte_and_partial():
    ru = CLEAN[4]
    out = g.examine([misread(ru.replace("—", "-").replace("№", "N").replace("«", "").replace("»", ""), "cp1251", s) for s in ("latin-1", "koi8-r", "cp866")])
    assert all(x is not None for x in out) and "лечение" in out[0][1]
    part = CLEAN[2] + " " + misread("Im Übrigen führte die Gabe zu größerer Nähe.", "utf-8", "cp1252")
    names, fixed = g.examine([part])[0]
    assert fixed == CLEAN[2] + " Im Übrigen führte die Gabe zu größerer Nähe." and names == ["utf-8>cp1252"]
    assert g.examine(["WeÕve found that 30 patients"])[0] is not None


def test_twice_and_lost():
    twice = misread(misread("verstärkte größere Nähe", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert g.examine([twice])[0][1] == "verstärkte größere Nähe"
    assert g.examine(["M�quet syndrome"])[0][0] == ["lost"]


def test_japanese():
    t = "ネスヒゲコの投与により有意に回復を示した。"
    assert g.examine([misread(t, "shift_jis", "latin-1")])[0][1] == t


MIXED = CLEAN[:8] + [misread(t, w, s) for t in CLEAN[1:5] for w, s in (("utf-8", "cp1252"), ("utf-8", "koi8-r")) if "😀" not in t]
MIXED += [misread(t, w, s) for t in ("ネスヒゲコの投与により有意に回復を示した。", "一方、回復した※参照。") for w, s in (("shift_jis", "latin-1"), ("euc_jp", "latin-1"))]
MIXED += [misread("Через неделю лечение помогло", "cp1251", "latin-1"), "plain words only", "x" * 40, "\n\n", "ä" * 30]


def plain_path(text):
    """The best path over all characters beyond ASCII, one after another, without leaving any out."""
    m, cp = g.model(), g.code_points([text])[0]
    at, gain = np.flatnonzero(cp >= 0x80), m.gains(cp)
    clean, v, back = 0.0, np.full(len(STATES), -1e9), []
    for x in gain.astype(np.float64):
        new = clean - g.ENTER
        best = int(v.argmax())
        out = v[best] - g.LEAVE
        back.append((new > v, best if out > clean else -1))
        v, clean = np.maximum(v, new) + x, max(clean, out)
    now = int(v.argmax()) if len(at) and v.max() > clean else -1
    states = []
    for entered, left in reversed(back):
        states.append(now)
        now = (-1 if entered[now] else now) if now >= 0 else left
    return {int(p) - 1: s for p, s in zip(at, reversed(states)) if s >= 0}


def states_of(text, spans):
    return {p: s for a, b, s in spans for p in range(a, b) if text[p] >= "\x80"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(MIXED), max_size=6).map(" ".join), min_size=1, max_size=4))
def test_leaving_out_what_is_surely_clean_changes_nothing(texts):
    found = g.spans_of(texts)
    assert [states_of(t, s) for t, s in zip(texts, found)] == [plain_path(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(MIXED), min_size=2, max_size=14).map("".join), st.sampled_from([40, 64, 150]), st.sampled_from([50, 400]))
def test_pieces_are_the_whole(text, piece, block):
    assert g.spans_of([text, "größer", text], piece, block) == g.spans_of([text, "größer", text])


def test_long_texts():
    text = ("plain words and größere Nähe " * 8000) + misread("größere Nähe", "utf-8", "latin-1")
    assert g.examine([text])[0][1].endswith("größere Nähe") and g.examine(["ä" * 120_000])[0] is None
    long = "größere Nähe, " * 20_000
    assert g.examine([misread(long, "utf-8", "cp1252")])[0][1] == long
    ja = "一方投与により有意に回復を示した" * 6000  # no character that ends a piece
    assert g.examine([misread(ja, "euc_jp", "latin-1")])[0][1] == ja


def test_misread_many_times():
    text = bad = "verstärkte größere Nähe, übrigens"
    for n in range(1, 7):
        bad = misread(bad, "utf-8", "cp1252")
        assert g.examine([bad])[0] is not None
        if n in (1, 2, 3, 6):
            assert g.examine([bad])[0][1] == text


def test_operator(spark):
    bad = misread("größere Nähe", "utf-8", "latin-1")
    df = spark.createDataFrame([(1, bad, "c"), (2, None, "c"), (3, "", "c"), (4, "größere Nähe", "c"), (5, bad, "c"), (5, bad, "c"), (6, "M�quet", "c")], "doc_id long, text string, restored string")
    got = sorted((r.doc_id, r.restored) for r in g.garbled(df, "doc_id", "text").collect())
    assert got == [(1, "größere Nähe"), (5, "größere Nähe"), (5, "größere Nähe"), (6, "M�quet")]
    assert g.garbled(df.limit(0), "doc_id", "text").count() == 0


def test_tables():
    assert len({s.name for s in STATES}) == len(STATES) and len(set(CLASSES)) == len(CLASSES)
    assert to_byte("cp1252")[0x20AC] == 0x80 and to_byte("cp1252")[0x81] == 0x81 and to_byte("koi8-r")[0x4E00] == -1
