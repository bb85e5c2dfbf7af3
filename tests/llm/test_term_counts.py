from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termforge.llm.term_counts import LastSeen, marked, term_counts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=6), max_size=12))
def test_counters_against_sets(records):
    seen = LastSeen()
    half = len(records) // 2
    for at, end in ((0, half), (half, len(records))):
        part = records[at:end]
        terms = sorted({t for r in part for t in r})
        code = np.array([terms.index(t) for r in part for t in r], np.int64)
        rec = np.array([at + i for i, r in enumerate(part) for _ in r], np.int64)
        if len(code):
            seen.add(terms, code, rec)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in seen.flush().to_pylist()}
    occ, recs = Counter(t for r in records for t in r), Counter(t for r in records for t in set(r))
    assert got == {t: (occ[t], recs[t]) for t in occ}


def result(df, column, **kw):
    return {r.term: (r.occurrences, r.records) for r in term_counts(df, F.col(column), **kw).collect()}


def test_strings_and_arrays(spark):
    rows = [("a  b a", ["x", "", None, "x"], 1, 9), (None, None, None, None), ("", [], 2, 2), ("a", ["X"], 3, 3), ("a", ["X"], 3, 3), ("é é a b", ["x y"], 4, 4)]
    df = spark.createDataFrame(rows, "text string, list array<string>, term long, records long").repartition(3)
    assert result(df, "text") == {"a": (4, 3), "b": (1, 1), "é": (1, 1), "é": (1, 1), "a b": (1, 1)}
    assert result(df, "list") == {"x": (2, 1), "": (1, 1), "X": (2, 2), "x y": (1, 1)}
    assert result(df, "text", max_terms=1) == result(df, "text")
    assert result(df.limit(0), "text") == {}


def test_long_text_and_marks(spark):
    df = spark.createDataFrame([("w " * 50_000 + "once",)] + [("w",)] * 60 + [("z",)] * 3, "t string")
    got = {r.term: (r.occurrences, r.mark) for r in marked(term_counts(df, F.col("t")), F.lit(df.count())).collect()}
    assert got == {"w": (50_060, "common"), "once": (1, "rare"), "z": (3, "common")}
