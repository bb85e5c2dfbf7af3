import itertools
import unicodedata

from pyspark.sql import functions as F

from termforge.llm.copies import Ledger, copies, copy_keys, ledger_of
from termforge.llm.lookalike import alike_map, alike_members, alike_pairs, consistent, with_consistent, with_one_form

SAME = [
    ("fever", "ｆｅｖｅｒ"), ("Zoé", "Zoé"), ("fever", "fe​ver﻿"), ("a b", "a b"), ("a b", "a b"), ("a b", "a　b"), ("scope", "ѕсоре"), ("HME", "ΗМЕ"),
    ("ガ", "ｶﾞ"), ("ガ", "ガ"), ("μ", "µ"), ("fe-v", "fe‑v"), ("soft", "so­ft"), ("odd", "оԁԁ"), ("Åk", "Å‍k"), ("Å", "Å"),
]
OTHER = [("fever", "Fever"), ("Zoe", "Zoé"), ("x2", "x²"), ("a b", "a  b"), ("a b", "a\tb"), ("a,b", "a.b"), ("カ", "ガ"), ("α", "a"), ("ß", "ss"), ("あ", "ア"), ("", "a")]
ENTRY = "id long, dictionary_id long, identifier string, label string, norm1 string, norm2 string, value string"


def entries(spark, rows):
    return spark.createDataFrame([(i, *r, None, None, "extra") for i, r in enumerate(rows, 1)], ENTRY)


def found(df):
    return {(r.id_a, r.id_b, r.field) for r in alike_pairs(df, "id", ["label", "norm1", "norm2"], ["dictionary_id", "identifier"]).collect()}


def test_map_has_no_chains():
    src, dst = alike_map()
    assert len(set(src)) == len(src) and not set(dst) & set(src) and len(dst) < len(src)


def test_same_and_other(spark):
    rows = [(1, f"s{i}", v) for i, p in enumerate(SAME) for v in p] + [(1, f"o{i}", v) for i, p in enumerate(OTHER) for v in p]
    assert found(entries(spark, rows)) == {(2 * i + 1, 2 * i + 2, "label") for i in range(len(SAME))}
    got = {r.i: r.c for r in spark.createDataFrame([(i, v) for i, v in enumerate(itertools.chain(*SAME, *OTHER))], "i int, v string").select("i", consistent(F.col("v")).alias("c")).collect()}
    n = 2 * len(SAME)
    assert all(got[i] == got[i + 1] for i in range(0, n, 2)) and all(got[i] != got[i + 1] for i in range(n, n + 2 * len(OTHER), 2))
    assert all(unicodedata.is_normalized("NFC", v) for v in got.values())


def test_groups_nulls_and_repeats(spark):
    rows = [(1, "x", "fever")] * 3 + [(1, "x", "fеver")] * 2 + [(2, "x", "fеver"), (None, "x", "fеver"), (1, None, "fеver"), (1, "x", None), (1, "y", "fеver"), (1, "x", "fe‍ver")]
    df = entries(spark, rows)
    alike = [1, 2, 3, 4, 5, 11]
    value = {i: rows[i - 1][2] for i in alike}
    assert found(df) == {(a, b, "label") for a, b in itertools.combinations(alike, 2) if value[a] != value[b]}
    assert found(df.limit(0)) == set()
    got = {r.id: r.canonical for r in with_consistent(df, "label", ["dictionary_id", "identifier"]).collect()}
    assert all(got[i] == "fever" for i in alike) and got[9] is None and got[6] == "fеver" and len(got) == len(rows)


def test_blocks_and_members_tell_the_same(spark):
    df = entries(spark, [(1, "x", v) for v in ["fever"] * 9 + ["fеver"] * 7 + ["fe\u200bver"] * 2 + ["cold"] * 3] + [(1, "y", "ﬁt"), (1, "y", "fit")])
    links = found(df)
    assert len(links) == 9 * 7 + 9 * 2 + 7 * 2 + 1
    for block in (2, 4):
        got = alike_pairs(df, "id", ["label", "norm1", "norm2"], ["dictionary_id", "identifier"], block).collect()
        assert len(got) == len(links) and {(r.id_a, r.id_b, r.field) for r in got} == links
    members = alike_members(df, "id", ["label", "norm1", "norm2"], ["dictionary_id", "identifier"]).collect()
    n = {r.id: r.n_links for r in members}
    assert n == {i: sum(i in p[:2] for p in links) for i in n} and len(n) == 20
    assert {r.id: r.class_id for r in members} == {i: 1 if i < 19 else 22 for i in n}


def test_long_text(spark):
    a = "long text " * 5000
    assert found(entries(spark, [(1, "x", a), (1, "x", a.replace("o", "о"))])) == {(1, 2, "label")}


def test_one_form_for_all_fields_and_groups(spark, tmp_path):
    from termforge.llm.queries import QUERIES

    rows = [
        (1, 1, "x", "fever", "f\u0435ver", None), (2, 2, "y", "f\u0435ver", "so\u00adlo", "so\u200blo"), (3, None, None, "fe\u200bver", "\uff46ever", "Zoe\u0301"),
        (4, 3, None, "Zo\u00e9", "\u0440\u043e\u0441\u0442", "\u0440\u043e\u0441\u200b\u0442"), (5, 1, "x", "Fever", "Zoe", "a\u00a0b"),
    ]
    spark.createDataFrame(rows, "id long, dictionary_id long, identifier string, label string, norm1 string, norm2 string").write.parquet(str(tmp_path / "entries.parquet"))
    got = {(r.id, r.field): r.canonical for r in QUERIES["p3_forms"](spark, str(tmp_path)).collect()}
    assert len(got) == 3 * len(rows) and got[1, "norm2"] is None
    assert {got[k] for k in [(1, "label"), (1, "norm1"), (2, "label"), (3, "label"), (3, "norm1")]} == {"fever"}
    assert got[2, "norm1"] == got[2, "norm2"] == "solo" and got[3, "norm2"] == got[4, "label"] == "Zo\u00e9"
    assert got[4, "norm1"] == got[4, "norm2"] == "\u0440\u043e\u0441\u0442"
    assert (got[5, "label"], got[5, "norm1"], got[5, "norm2"]) == ("Fever", "Zoe", "a b")


def test_one_form_of_every_look(spark):
    values = [v for p in [*SAME, *OTHER] for v in p]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.canonical for r in with_one_form(df, "v").collect()}
    n = 2 * len(SAME)
    assert all(got[i] == got[i + 1] for i in range(0, n, 2)) and all(got[i] != got[i + 1] for i in range(n, len(values), 2))


COPY = "id long, dictionary_id long, label string, identifier string, created_at timestamp_ntz, k1 string"


def copy_rows(spark, rows):
    import datetime

    day = lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i * 37 % 11) if i % 4 else None
    return spark.createDataFrame([(i, *r, day(i), "clash") for i, r in enumerate(rows, 1)], COPY)


ROWS = [
    (1, "Fever, high", "HP:1"), (1, "FEVER HIGH", "hp1"), (1, "HP_1", "fever-high"), (1, "ｆｅｖｅｒ high", "HP 1"), (2, "Fever, high", "HP:1"), (1, "Févèr high", "HP:1"), (1, "Fever, high", "HP:1"),
    (1, "x²", "A"), (1, "x2", "A"), (None, "Fever, high", "HP:1"), (1, None, "HP:1"), (1, "Fever, high", None), (1, "--", ""), (1, "", "..."), (1, "feverhigh", "HP:2"), (1, "Zoé", "B"), (1, "ZOÉ", "b"),
]
GROUPS = [{1, 2, 3, 4, 7}, {13, 14}, {16, 17}]


def test_copies_by_slices(spark):
    df = copy_rows(spark, ROWS)
    for slices in (1, 3, 5):
        keyed, ledger = ledger_of(df, "id", ["dictionary_id"], ["label", "identifier"], "created_at", slices)
        got = {(r.first_id, r.copy_id) for r in copies(keyed, ledger).collect()}
        assert got == {(min(g), i) for g in GROUPS for i in g if i != min(g)}
        counts = sorted(r.copies for r in ledger.collect())
        assert counts == [1] * 5 + [2, 2, 5] and sum(counts) == keyed.count() == 14


def test_ledger_takes_batches_and_hot_keys(spark):
    df = copy_rows(spark, [(1, "Hot", "H")] * 400 + [(1, f"cold {i}", "C") for i in range(30)])
    ledger, keys = Ledger(spark, buckets=3), copy_keys(df, "id", ["dictionary_id"], ["label", "identifier"])
    assert ledger.table().count() == 0
    for part in (keys.where("id > 200"), keys.where("id <= 200"), keys.where("false")):
        ledger.add(part)
    top = ledger.table().orderBy(F.desc("copies")).first()
    assert (top.copies, top.first_id) == (400, 1) and ledger.table().count() == 31


def state(ledger):
    return {(r.k1, r.k2): (r.copies, r.first_id) for r in ledger.table().collect()}


def test_ledger_goes_on_in_another_process(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    df = copy_rows(spark, [(1, f"term {i % 40}", "C") for i in range(120)])
    keys = copy_keys(df, "id", ["dictionary_id"], ["label", "identifier"])
    keys.write.parquet(str(tmp_path / "keys"))
    code = f"""if True:
        from termforge.llm.copies import Ledger
        from termforge.session import local_session
        s = local_session(2)
        first = Ledger(s, "{tmp_path}/ledger", buckets=6)
        assert first.versions == [] and first.add(s.read.parquet("{tmp_path}/keys").where("id <= 50"), "monday")
    """
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(Path(__file__).resolve().parents[2]), capture_output=True)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.versions == [1] and ledger.state["buckets"] == 6
    assert not ledger.add(keys.where("id <= 50"), "monday") and ledger.add(keys.where("id > 50"), "tuesday")
    whole = Ledger(spark, buckets=6)
    whole.add(keys)
    assert state(Ledger(spark, str(tmp_path / "ledger"))) == state(whole) and len(state(whole)) == 40


def test_ledger_rewrites_touched_buckets_only(spark, tmp_path):
    df = copy_rows(spark, [(1, f"term {i % 60}", "C") for i in range(180)])
    keys = copy_keys(df, "id", ["dictionary_id"], ["label", "identifier"]).cache()
    ledger = Ledger(spark, str(tmp_path / "l"), buckets=8)
    ledger.add(keys.where("id <= 100"), "a")
    (first,) = ledger.state["segments"]
    one = keys.where("id > 100").orderBy("k1").limit(1)
    ledger.add(one, "b")
    touched = ledger.state["segments"]
    assert len(touched) == 2 and len(touched[first]) == 7 and sum(map(len, touched.values())) == 8
    ledger.add(keys.where("id > 100").join(one.select("id"), "id", "left_anti"), "c")
    assert not ledger.add(keys, "b")
    plain = {}
    for r in keys.collect():
        n, i = plain.get((r.k1, r.k2), (0, r.id))
        plain[r.k1, r.k2] = (n + 1, min(i, r.id))
    assert state(ledger) == plain


def test_ledger_that_failed_has_changed_nothing(spark, tmp_path):
    import pytest

    keys = copy_keys(copy_rows(spark, [(1, f"term {i}", "C") for i in range(20)]), "id", ["dictionary_id"], ["label", "identifier"])
    Ledger(spark, str(tmp_path / "l"), buckets=2).add(keys, "a")
    before = state(Ledger(spark, str(tmp_path / "l")))
    with pytest.raises(Exception, match="lost"):
        Ledger(spark, str(tmp_path / "l")).add(keys.withColumn("id", F.raise_error(F.lit("lost")).cast("long")), "b")
    again = Ledger(spark, str(tmp_path / "l"))
    assert state(again) == before and again.state["batches"] == ["a"]
    late = Ledger(spark, str(tmp_path / "l"))
    again.add(keys, "b")
    with pytest.raises(FileExistsError):
        late.add(keys, "c")


def test_hot_key_stays_spread(spark):
    keyed = spark.range(1, 20_001).select("id", F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k1"), F.lit(1).cast("long").alias("k2")).repartition(8)
    ledger = Ledger(spark, buckets=4)
    ledger.add(keyed)
    out = copies(keyed, ledger.table())
    sizes = sorted(r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect())
    assert sum(sizes) == 17_999 and len(sizes) >= 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
