import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termforge.functions import text as t
from termforge.functions.abbreviations import local_abbreviations
from termforge.functions.patterns import compiled, matches, usable
from termforge.functions.porter2 import stem
from termforge.functions.resolve import Denotation, consolidated, merged, ordered, resolve, without_crossings, without_embedded

# Published sample stems.
STEMS = {
    "consigned": "consign", "consistency": "consist", "consolatory": "consolatori", "knackeries": "knackeri", "knitted": "knit", "generate": "generat", "generous": "generous",
    "happily": "happili", "flies": "fli", "ties": "tie", "dying": "die", "hoping": "hope", "hopping": "hop", "relational": "relat", "national": "nation", "say": "say", "cry": "cri", "gas": "gas",
    "this": "this", "feed": "feed", "agreed": "agre", "luxuriated": "luxuri", "skies": "sky", "news": "news", "inning": "inning", "conditional": "condit", "sensibility": "sensibl",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_norms():
    assert t.normalize1("Cytokine storm") == "cytokinestorm"
    assert t.normalize1("Héllo {Wörld} ＡＢ") == "helloworldab"
    assert t.normalize2("the storms of an anomaly") == "stormananomali"
    assert t.normalize1("ガラス") == "ガラス"
    assert t.normalize1(None) is None and t.normalize2("") == ""
    assert [x.norm1 for x in t.tokens("e.g. 1,234.5 alpha-2 don't")] == ["e.g", "1,234.5", "alpha", "2", "don't"]


def test_breaks_and_levels():
    s = "See it. Then (a (b) c) d\nE"
    assert t.sentence_breaks(s) == [7, 24]
    toks = t.tokens(s)
    t.add_levels(toks, s, t.sentence_breaks(s))
    assert [x.level for x in toks] == [0, 0, 0, 1, 2, 1, 0, 0]
    assert toks[3].opens and toks[4].closes and not toks[0].opens


@given(st.text(st.sampled_from("aB1.!'( \n\t頭カーひ\u0301"), max_size=30))
@settings(max_examples=500, deadline=None)
def test_crossings(s):
    toks, breaks = t.tokens(s), t.sentence_breaks(s)
    want = sum(t.crosses(breaks, a.begin, z.end) for a, z in zip(toks, toks[1:]))
    assert t.crossings(s) == (want if len(toks) > 1 else None)


def spans(s, **rules):
    toks, breaks = t.tokens(s), t.sentence_breaks(s)
    t.add_levels(toks, s, breaks)
    return [s[x.begin : x.end] for x in t.candidate_spans(toks, breaks, t.SpanRules(**rules))]


def test_candidate_spans():
    assert spans("high fever now", longest=2) == ["high", "high fever", "fever", "fever now", "now"]
    assert spans("a fever and b", longest=3, no_term=frozenset(["and"])) == ["a", "a fever", "fever", "b"]
    assert spans("End. Begin", longest=2) == ["End", "Begin"]
    assert "cell (T)" in spans("cell (T) x", longest=2) and "cell (T" not in spans("cell (T) x", longest=2)
    assert spans("of the", longest=2) == []
    assert spans("", longest=2) == []


@given(st.text(st.sampled_from("abT1.,'- ()\n頭カーひé\u0301"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_norms_of_a_span_follow_from_its_text(s):
    toks, breaks = t.tokens(s), t.sentence_breaks(s)
    t.add_levels(toks, s, breaks)
    for x in t.candidate_spans(toks, breaks, t.SpanRules()):
        assert t.norms(s[x.begin : x.end]) == (x.norm1, x.norm2)


def test_semantic_prefilter():
    assert [x for x in ["a", "ab", "abc", "abcd", "fever"] if t.worth_embedding(x)] == ["abc", "abcd", "fever"]
    assert [x for x in ["123", "45.67", "1,234", "abc123", "test", "12 34"] if t.worth_embedding(x)] == ["abc123", "test"]


def test_abbreviations():
    assert t.abbreviation_type("TNF", "tumor necrosis factor") == "regAbbreviation"
    assert t.abbreviation_type("TNF", "TumorNecrosisFactor") == "regAbbreviation"
    assert t.abbreviation_type("tumr", "tumor") == "freeAbbreviation"
    assert t.abbreviation_type("xyz", "tumor") is None
    s = "The tumor necrosis factor (TNF) binds. TNF rises; a TNF-like one."
    toks = t.tokens(s)
    t.add_levels(toks, s, t.sentence_breaks(s))
    found = local_abbreviations(s, toks, [Denotation(4, 25, "X:1", 1.0, "tumor necrosis factor")])
    assert [(d.begin, d.end, d.abbr_type) for d in found] == [(27, 30, "regAbbreviation"), (39, 42, "regAbbreviation"), (52, 55, "regAbbreviation")]
    assert local_abbreviations("", [], []) == []


def d(a, b, obj, score=1.0):
    return Denotation(a, b, obj, score)


def test_consolidation():
    three = [d(0, 33, "T", 0.8689), d(17, 37, "T", 0.925), d(17, 33, "T", 0.9447)]
    assert resolve(three) == [d(17, 33, "T", 0.9447)]
    assert len(consolidated(ordered([d(0, 5, "H"), d(20, 25, "H")]))) == 2
    assert len(consolidated(ordered([d(0, 9, "A"), d(4, 12, "B")]))) == 2


def test_crossings_and_embedded():
    assert without_crossings([d(0, 10, "A", 0.9), d(5, 15, "B", 0.95)]) == [d(5, 15, "B", 0.95)]
    assert without_crossings([d(0, 10, "A", 0.9), d(5, 15, "B", 0.9)]) == [d(0, 10, "A", 0.9)]
    outer, inner = d(0, 20, "A", 0.9), d(0, 5, "B", 0.95)
    assert without_embedded([outer, inner]) == [outer]
    assert without_embedded([outer, inner], longest=False) == [outer, inner]
    weak = d(0, 5, "B", 0.5)
    assert without_embedded([outer, weak], longest=False) == [outer]
    assert without_embedded([outer, weak], longest=False, superfluous=True) == [outer, weak]
    tie = d(0, 20, "B", 0.9)
    assert without_embedded([outer, tie]) == [outer, tie]
    assert without_embedded([outer, d(3, 5, "A", 0.95)]) == [d(3, 5, "A", 0.95)]
    assert merged([outer], [Denotation(0, 20, "A", None, abbr_type="x"), Denotation(30, 33, "A", None, abbr_type="x")])[1].begin == 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.sampled_from("ABC"), st.sampled_from([0.85, 0.9, 1.0])), max_size=12), st.booleans(), st.booleans())
def test_no_partial_overlap(raw, longest, superfluous):
    out = resolve([d(a, a + n, o, s) for a, n, o, s in raw], longest, superfluous)
    for x in out:
        for y in out:
            assert not (x.begin < y.begin < x.end < y.end)
    again = resolve([d(a, a + n, o, s) for a, n, o, s in random.Random(1).sample(raw, len(raw))], longest, superfluous)
    assert again == out


def test_patterns():
    assert matches("ab12 cd34", r"(?<n>\d+)") == [(2, 4), (7, 9)]
    assert compiled(r"\h+\z").pattern == r"[0-9a-fA-F]+\Z"
    assert matches("x\ny", "^y$") == [(2, 3)]
    assert matches("é1", r"\p{L}") == [(0, 1)] and matches("ab ac", r"a\Kc") == [(4, 5)]
    for bad in ("(", "[a", r"(?<n", "a{2,1}"):
        assert not usable(bad)
        with pytest.raises(ValueError):
            compiled(bad)


def test_decapitalize_and_simple_tokens():
    assert t.decapitalize("Big Word AB") == "big word AB"
    assert [x[0] for x in t.simple_tokens("a-b_c d")] == ["a", "-", "b", "_", "c", "d"]
