import random
import zipfile

import pytest
from pyspark.sql import functions as F

from termforge.functions import similarity as sim
from termforge.functions.vectors import cosine_distance
from termforge.operators import annotate as a
from termforge.operators import edits, filters, jobs, lookup
from termforge.operators.bitmap import may_hold, string_bitmap, string_hash
from termforge.operators.knn import exact_knn
from termforge.operators.ngram import similarity_join
from termforge.sources import embedder, entry_file, export

DICT = "id long, name string, threshold double, language string, tokens_len_min int, tokens_len_max int, no_term_words array<string>, no_begin_words array<string>, no_end_words array<string>"
ENTRY = "id long, dictionary_id long, label string, identifier string, norm1 string, norm2 string, mode int, dirty boolean, searchable boolean, created_at timestamp_ntz"


def dictionary(spark, threshold=0.85, words=None):
    return spark.createDataFrame([(1, "clinical", threshold, "eng", 1, 6, words, words, words)], DICT)


def entries(spark, rows):
    full = [(i, 1, label, ident, label.lower().replace(" ", ""), label.lower().replace(" ", ""), mode, False, True, None) for i, (label, ident, mode) in enumerate(rows, 1)]
    return spark.createDataFrame(full, ENTRY)


CLINICAL = [("Cytokine storm", "HP:0033041", 0), ("Fever", "HP:0001945", 0), ("Headache", "HP:0002315", 0)]


def annotated(spark, text, rows=CLINICAL, words=None, **options):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = a.exploded(a.annotate(docs, entries(spark, rows), dictionary(spark, words=words), a.Options(**options)))
    return sorted((r.begin, r.end, r.obj, r.score, r.abbr_type) for r in out.collect())


def test_annotate_repeated_terms(spark):
    got = annotated(spark, "Fever in morning, fever at night", longest=False)
    assert [g[:3] for g in got] == [(0, 5, "HP:0001945"), (18, 23, "HP:0001945")] and got[0][3] == 1.0
    assert got[1][3] == pytest.approx(0.9375)


def test_annotate_with_dots(spark):
    got = annotated(spark, "E. coli and then E. coli again", [("E. coli", "NCBITaxon:562", 0)], words=[], threshold=0.0, longest=False)
    assert [(g[0], g[1]) for g in got] == [(0, 7), (17, 24)] and all(g[3] == 1.0 for g in got)


def test_annotate_black_and_exact(spark):
    assert annotated(spark, "Fever", [("Fever", "X", 2)], threshold=1.0) == []
    assert [g[:3] for g in annotated(spark, "fever Fever", threshold=1.0)] == [(6, 11, "HP:0001945")]


def test_annotate_abbreviation(spark):
    got = annotated(spark, "A cytokine storm (CS) came. CS left.", longest=True)
    assert [(g[0], g[1], g[4]) for g in got] == [(2, 16, None), (18, 20, "regAbbreviation"), (28, 30, "regAbbreviation")]
    assert len(annotated(spark, "A cytokine storm (CS) came. CS left.", abbreviation=False)) == 1


def test_annotate_ngram(spark):
    assert annotated(spark, "headaches x", threshold=0.5) != []
    near = annotated(spark, "Headachee", threshold=0.4)
    assert near == [] and annotated(spark, "Headachee", threshold=0.4, use_ngram_similarity=True)[0][2] == "HP:0002315"


def test_bitmap_hash_is_the_engines(spark):
    words = ["", "a", "fever", "ñandú", "漢字" * 40]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    theirs = {r.w: r.h & (2**64 - 1) for r in df.select("w", F.xxhash64("w").alias("h")).collect() if r.w is not None}
    assert theirs == {w: string_hash(w) for w in words}
    bits = string_bitmap(df, "w")
    assert all(may_hold(bits, w) for w in words) and not may_hold(bits, "absent")


def test_similarity_columns(spark):
    df = spark.createDataFrame([("Fever", "fever"), ("a", "a"), ("banana", "bananas"), ("", "x"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(sim.jaccard(sim.circular_trigrams(F.col("a")), sim.circular_trigrams(F.col("b")))).collect()]
    assert got == [0.25, 1.0, 0.375, 0.0, 0.0]
    s = df.select(sim.str_sim_3gram(F.lit("fever"), F.lit("Fever"), *[F.lit("fever")] * 4)).first()[0]
    assert s == pytest.approx(0.9375)


def test_ngram_join_against_all_pairs(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(90)})
    df = spark.createDataFrame([(w,) for w in [*words, "", None]], "w string")

    def grams(s):
        p = s[-1] + s + s[0]
        return {p[i : i + 3] for i in range(len(s))}

    for measure in ("jaccard", "cosine"):
        for t in (0.5, 0.7, 1.0):
            got = {(r.left, r.right) for r in similarity_join(df, "w", df, "w", t, measure=measure).collect()}
            size = lambda x, y: len(grams(x) | grams(y)) if measure == "jaccard" else (len(grams(x)) * len(grams(y))) ** 0.5
            assert got == {(x, y) for x in words for y in words if len(grams(x) & grams(y)) / size(x, y) >= t - 1e-12}


def test_exact_knn_with_ties(spark):
    rng = random.Random(5)
    rows = [(i, None, [float(rng.randint(-2, 2)) for _ in range(3)] or [1.0]) for i in range(60)]
    rows = [(i, g, v if any(v) else [1.0, 0.0, 0.0]) for i, g, v in rows]
    df = spark.createDataFrame(rows, "id long, grp string, vec array<double>")
    q = df.where("id % 5 = 0").withColumnRenamed("id", "no")
    got = {(r.query, r.rank): r.id for r in exact_knn(q, df, 4, query_blocks=2, row_blocks=3).collect()}
    d = df.alias("a").join(df.alias("b"), F.col("a.id") != F.col("b.id")).where("a.id % 5 = 0")
    d = d.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.round(cosine_distance(F.col("a.vec"), F.col("b.vec")), 12).alias("d")).collect()
    want = {}
    for x in {r.x for r in d}:
        for n, (_, y) in enumerate(sorted((r.d, r.y) for r in d if r.x == x)[:4], 1):
            want[x, n] = y
    assert got == want


TAGGED = [("glucose", "CHEBI:17234", "chemistry"), ("protein", "GO:0003674", "biology"), ("enzyme", "GO:0003824", "chemistry,biology"), ("insulin", "CHEBI:145810", "chemistry,biology,medicine"), ("water", "CHEBI:15377", "")]


def test_find_ids_by_tags(spark):
    e = entries(spark, [(x, y, 0) for x, y, _ in TAGGED])
    tags = spark.createDataFrame([(1, 1, "chemistry"), (2, 1, "biology"), (3, 1, "medicine")], "id long, dictionary_id long, value string")
    no = {"chemistry": 1, "biology": 2, "medicine": 3}
    given = spark.createDataFrame([(i, no[t]) for i, r in enumerate(TAGGED, 1) for t in r[2].split(",") if t], "entry_id long, tag_id long")
    labels = spark.createDataFrame([(x,) for x, *_ in TAGGED] + [(None,), ("unknown",)], "label string")

    def hits(values):
        out = lookup.find_ids(labels, e, dictionary(spark), threshold=1.0, tags=values, entry_tags=given, tag_table=tags)
        got = {r.label: r.identifiers for r in out.collect()}
        assert set(got) == {x for x, *_ in TAGGED} | {"unknown"} and all(len(v) <= 1 for v in got.values())
        return {k for k, v in got.items() if v}

    assert hits(["chemistry"]) == {"glucose", "enzyme", "insulin"}
    assert hits(["chemistry", "biology"]) == {"glucose", "protein", "enzyme", "insulin"}
    assert hits([]) == {x for x, *_ in TAGGED} and hits(["none"]) == set()


def test_unknown_dictionary(spark):
    found = lookup.find_dictionaries(dictionary(spark), ["clinical", "clinical"])
    assert found.count() == 2
    with pytest.raises(ValueError, match="unknown dictionary: a, b."):
        lookup.find_dictionaries(dictionary(spark), ["a", "clinical", "b"])


def test_loader(spark, tmp_path):
    f = tmp_path / "e.txt"
    f.write_text(
        "#label\tid\tidentifier\n# comment\n\nglucose\tCHEBI:17234\tchemistry\nglucose\tCHEBI:17234\tbiology\nfructose\tCHEBI:28757\t\textra\tmore\nsucrose\tCHEBI:17992\n"
        '"glucose, alpha-D-",CHEBI:17925,\nxylose,CHEBI:1,"chemistry,biology"\nx\tTOO:SHORT\n' + "y" * 128 + "\tTOO:LONG\nlabel\t" + "i" * 256 + "\nonlyone\n"
    )
    load = entry_file.read_entries(spark, str(f))
    got = {(r.label, r.identifier): (r.line_no, r.tags) for r in load.entries.orderBy(F.desc("line_no")).collect()}
    assert got["glucose", "CHEBI:17234"] == (4, ["chemistry"]) and got["glucose, alpha-D-", "CHEBI:17925"][1] == []
    assert got["xylose", "CHEBI:1"][1] == ["chemistry", "biology"] and got["sucrose", "CHEBI:17992"][1] == [] and len(got) == 5
    assert sorted(r.reason for r in load.rejected.collect()) == ["identifier length", "label length", "label length", "too few items"]
    old = entries(spark, [("sucrose", "CHEBI:17992", 0)])
    tags = spark.createDataFrame([(7, 1, "biology")], "id long, dictionary_id long, value string")
    new, new_tags, given = edits.bulk_insert(old, load.entries, tags, 1)
    assert [(r.id, r.label) for r in new.orderBy("id").collect()] == [(2, "glucose"), (3, "fructose"), (4, "glucose, alpha-D-"), (5, "xylose")]
    assert [(r.id, r.value) for r in new_tags.collect()] == [(8, "chemistry")]
    assert sorted(map(tuple, given.collect())) == [(2, 8), (5, 7), (5, 8)]
    with pytest.raises(ValueError):
        entry_file.require_empty(old, 1)
    bad = tmp_path / "bad.txt"
    bad.write_text("glucose\tX:1\tno good\n")
    with pytest.raises(Exception, match="invalid tags"):
        entry_file.read_entries(spark, str(bad)).entries.collect()


def test_line_numbers_over_splits(spark, tmp_path):
    f = tmp_path / "big.txt"
    f.write_text("".join(f"label {i}\tID:{i}\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = entry_file.numbered_lines(spark, str(f))
        assert spark.read.text(str(f)).rdd.getNumPartitions() > 2
        assert all(r.line == f"label {r.line_no}\tID:{r.line_no}" for r in rows.collect()) and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_engine(spark, data):
    from termforge.engine import Engine
    from termforge.operators import params

    e = Engine.of_folder(spark, data)
    label = e.entries.join(filters.public(e.dictionaries).select(F.col("id").alias("dictionary_id")), "dictionary_id").where("mode = 0 AND length(label) > 5 AND identifier IS NOT NULL").orderBy("id").first()
    ids = {r.label: r.identifiers for r in e.find_ids([label.label, "no such label"], threshold=1.0).collect()}
    assert label.identifier in ids[label.label] and ids["no such label"] == []
    name = e.dictionaries.where(F.col("id") == label.dictionary_id).first().name
    terms = e.find_terms([label.identifier], [name], True).collect()
    assert label.label in [x.label for x in terms[0].labels]
    assert e.complete(label.label, name, "substring").count() >= 1
    if "," not in label.label:
        assert label.label in e.tool("find_ids", {"labels": label.label, "dictionary": name})
    assert name in e.tool("list_dictionaries", {}) and name in e.tool("get_dictionary_description", {"name": name})
    out = e.annotate_texts([f"We saw {label.label} today.", ""], options=params.annotation_options({"threshold": "1", "longest": "0", "superfluous": "1"}))
    assert out[1]["denotations"] == [] and any(d["string"] == label.label for d in out[0]["denotations"])
    with pytest.raises(ValueError):
        e.tool("nothing", {})


def test_params():
    from termforge.operators import params as p

    assert [p.to_boolean(x) for x in (None, "true", "1", "yes", True)] == [False, True, True, False, True]
    assert (p.to_integer("x"), p.to_integer(" 3 "), p.to_float("0.5"), p.to_float("")) == (None, 3, 0.5, None)
    assert p.to_array("a|b, c\n\td") == ["a", "b", "c", "d"] and p.to_array(None) == [] and p.body_lines("a\n\nb,c") == ["a", "b", "c"]
    assert p.annotation_options({}).longest and not p.annotation_options({"longest": "false"}).longest


def test_normalize_str():
    from termforge.functions.normalize_text import normalize_str

    assert normalize_str("Big-Cells  divided", stems=True, hyphens_to_spaces=True, lowercase=True) == "big cell  divid"


def test_exports(spark, tmp_path):
    e = entries(spark, [("a\tb", "X:1", 1), ('say "hi"', "X:2", 2), ("plain", "X:3", 0)])
    tags = spark.createDataFrame([(1, 1, "t1"), (2, 1, "t2")], "id long, dictionary_id long, value string")
    given = spark.createDataFrame([(3, 2), (3, 1), (3, 1)], "entry_id long, tag_id long")
    header, lines = export.entry_lines(e, given, tags, True)
    assert header == "#label\tid\t#tags\toperator"
    assert [r.line for r in lines.orderBy("id").collect()] == ['"a\tb"\tX:1\t\t+', '"say ""hi"""\tX:2\t\t-', "plain\tX:3\tt1,t2\t"]
    assert export.entry_lines(e, given.limit(0), tags)[0] == "#label\tid"
    path = export.write_zip("my  dict", header, lines, str(tmp_path))
    with zipfile.ZipFile(path) as z:
        assert z.namelist() == ["my_dict.csv"] and z.read("my_dict.csv").decode().startswith(header + "\n")
    assert export.is_stale(path, 4e9) and not export.is_stale(path, 0)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    export.write_results(docs, str(tmp_path), "j1")
    assert export.result_status(str(tmp_path), "j1") == "success" and export.result_status(str(tmp_path), "j2") == "not_found"
    assert export.purge(str(tmp_path), now=4e9) == ["annotation-j1.json"]


def test_modes(spark):
    e = entries(spark, [("aa", "1", 0), ("bb", "2", 1), ("cc", "3", 2)])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    modes = lambda df: {r.id: (r.mode, r.searchable) for r in df.collect()}
    assert modes(edits.turn_to_black(e, ids(1)))[1] == (2, False)
    with pytest.raises(Exception, match="mode doesn't allow this"):
        edits.turn_to_white(e, ids(3)).collect()
    assert modes(edits.undo(e, ids(2, 3))) == {1: (0, True), 3: (0, True)}
    with pytest.raises(ValueError):
        edits.empty_entries(e, e, e, 1, 5)


def test_jobs(spark):
    df = spark.createDataFrame([(90061,), (3600,), (59,)], "s long")
    assert [r[0] for r in df.select(jobs.duration_words(F.col("s"))).collect()] == ["1d 1h 1m 1s", "1h 0m 0s", "59s"]


def test_retry_and_embedder(spark):
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise TimeoutError

    with pytest.raises(embedder.ServerError):
        embedder.with_retry(fail, wait=waits.append)
    assert waits == [2, 4] and len(calls) == 3 and embedder.models("http://127.0.0.1:9/x") == []


def test_stream(spark, tmp_path):
    from termforge.streaming.annotate_stream import annotate_stream, document_stream

    spark.createDataFrame([(1, "Fever"), (2, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = annotate_stream(document_stream(spark, str(tmp_path / "in")), entries(spark, CLINICAL), dictionary(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_pages(spark):
    e = spark.range(1, 40)
    assert [r.id for r in filters.page(e.orderBy("id"), 2, 15).collect()] == list(range(16, 31)) and filters.page(e, 0).count() == 15


def test_combined_and_embedded_spans(spark, data, tmp_path):
    import os

    from termforge.functions.udfs import hash_embedder
    from termforge.plans.annotate_queries import QUERIES

    for name in ("entries", "dictionaries"):
        os.symlink(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    labels = spark.read.parquet(f"{data}/entries.parquet").where("label RLIKE '^[a-z]{5,}( [a-z]{5,})?$'").select("label").distinct().orderBy("label").limit(60).collect()
    text = ". ".join(["purple zebra", *(r.label for r in labels)]) + "."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    surface = QUERIES["ann_surface"](spark, str(tmp_path)).orderBy(F.desc("score"), "span", "identifier").first()
    named = [(1, "purple zebra", "ZEBRA"), (2, surface.span, surface.identifier)]
    rows = spark.createDataFrame([(i, 16, x, o, True) for i, x, o in named], "id long, dictionary_id long, label string, identifier string, searchable boolean")
    rows.withColumn("embedding", hash_embedder(64)("label")).write.parquet(str(tmp_path / "semantic_dict_16.parquet"))
    got = [(r.span, r.identifier, r.dictionary_id) for r in QUERIES["ann_combine"](spark, str(tmp_path)).collect()]
    assert ("purple zebra", "ZEBRA", 16) in got
    assert sum(x[:2] == (surface.span, surface.identifier) for x in got) == 1
    embedded = [r.span for r in QUERIES["ann_embed"](spark, str(tmp_path)).collect()]
    assert "purple zebra" in embedded and len(set(embedded)) == len(embedded)


def test_semantic_matches_count_per_dictionary(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    axis = np.eye(8)[0]
    rows = [(i, 1, f"a{i}", f"A{i}", True, (axis + 0.01 * rng.normal(size=8)).tolist()) for i in range(1, 31)]
    rows += [(i, 2, f"b{i}", f"B{i}", True, (axis + 0.1 * rng.normal(size=8)).tolist()) for i in range(31, 35)]
    rows += [(40, 1, "a40", "A40", False, axis.tolist()), (41, 2, "b41", "B41", True, np.eye(8)[1].tolist())]
    vectors = spark.createDataFrame(rows, "id long, dictionary_id long, label string, identifier string, searchable boolean, embedding array<float>")
    spans = spark.createDataFrame([("some span", "some span", "some span")], "span string, norm1 string, norm2 string")
    embed = lambda c: F.array(*[F.lit(float(x)) for x in axis])
    sims = {r[0]: np.dot(np.float32(r[5]), axis) / np.linalg.norm(np.float32(r[5])) for r in rows}
    want = {f"A{i}" for i in sorted(range(1, 31), key=lambda i: -sims[i])[:10]} | {f"B{i}" for i in range(31, 35)}
    assert {r.identifier for r in a.semantic_matches(spans, vectors, embed, 0.6).collect()} == want
    semantic = vectors.where("dictionary_id = 1")
    entries = vectors.withColumn("searchable", F.lit(False))
    both = a.semantic_matches(spans, a.vectors_of(semantic, entries), embed, 0.6)
    assert {r.identifier for r in both.collect()} == want


def test_annotate_ngram_with_own_threshold(spark):
    docs = spark.createDataFrame([(1, "Headachee")], "doc_id long, text string")
    found = a.exploded(a.annotate(docs, entries(spark, CLINICAL), dictionary(spark, 0.4), a.Options(use_ngram_similarity=True))).collect()
    assert [r.obj for r in found] == ["HP:0002315"]


def clinical_engine(spark):
    from termforge.engine import Engine

    d = dictionary(spark).withColumns({"public": F.lit(True), "description": F.lit("of the clinic"), "created_at": F.lit(None).cast("timestamp_ntz")})
    tagged = spark.createDataFrame([(2, 5)], "entry_id long, tag_id long"), spark.createDataFrame([(5, 1, "sign")], "id long, dictionary_id long, value string")
    return Engine(entries(spark, CLINICAL), d, *tagged)


def test_engine_load_export_compile(spark, tmp_path):
    e = clinical_engine(spark)
    with pytest.raises(ValueError):
        e.load(str(tmp_path), "clinical")
    lines = ["#label\tid", "glucose\tCHEBI:17234\tsugar", "glucose\tCHEBI:17234\tother", '"a, b",CHEBI:1,"x,y"', "x\tI", "lonely", "", "fructose\tCHEBI:28757\t"]
    (tmp_path / "in.tsv").write_text("\n".join(lines) + "\n")
    empty = e.entries.where("mode = 2")
    from dataclasses import replace

    loaded, done = replace(e, entries=empty, entry_tags=e.entry_tags.limit(0)).load(str(tmp_path / "in.tsv"), "clinical")
    assert sorted((r.label, r.identifier, r.norm1) for r in loaded.entries.collect()) == [("a, b", "CHEBI:1", "ab"), ("fructose", "CHEBI:28757", "fructose"), ("glucose", "CHEBI:17234", "glucose")]
    assert [(r.line_no, r.line, r.reason) for r in done.skipped.orderBy("line_no").collect()] == [(5, "x\tI", "label length"), (6, "lonely", "too few items")]
    assert done.report.first() == (8, 3, 2)
    assert sorted(r.value for r in loaded.tags.collect()) == ["sign", "sugar", "x", "y"] and loaded.entry_tags.count() == 3
    assert loaded.export("clinical", str(tmp_path / "out"), with_operator=True) == "#label\tid\t#tags\toperator"
    assert loaded.export("clinical", str(tmp_path / "out2"), mode=1) == "#label\tid"
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())[:2] == ["#label\tid\t#tags\toperator", "a, b\tCHEBI:1\tx,y\t"]
    compiled, index = e.compile(str(tmp_path / "index"))
    assert {r.gram for r in index.postings.where("norm2 = 'fever'").collect()} == {"rfe", "fev", "eve", "ver", "erf"}
    words = compiled.dictionaries.first().no_term_words
    assert words and "is" in words
    docs = spark.createDataFrame([(1, "Fever at night")], "doc_id long, text string")
    assert a.exploded(compiled.annotate(docs, ["clinical"])).collect() == a.exploded(e.annotate(docs, ["clinical"])).collect() != []


def test_engine_analysis(spark):
    from dataclasses import replace

    rows = [(i, 1, f"t{i}", f"I{i // 3}", True, [1.0 + i % 3 * 0.1, float(i // 3), 0.5]) for i in range(12)]
    semantic = spark.createDataFrame(rows, "id long, dictionary_id long, label string, identifier string, searchable boolean, embedding array<float>")
    e = replace(clinical_engine(spark), semantic=semantic)
    an = replace(e.analyze, dim=3)
    assert an.centroid().count() == 1 and an.clusters().count() == 12 and an.similar([1], 2).count() == 2
    assert an.leave_one_out().first().total_searchable == 12
    origins = spark.createDataFrame([(0, "x", [1.0, 0.0, 0.5])], "no int, term string, vec array<double>")
    near = an.origin_outliers(origins, 0.01).count()
    report = an.clean_by_origin(origins, 0.01).report.first()
    assert report.n_outliers == near > 0 and report.total_searchable_before == 12 and report.total_searchable_after == 12 - near
    with pytest.raises(ValueError):
        clinical_engine(spark).analyze


def test_tool_protocol(spark):
    import json

    from termforge.tools import respond

    e = clinical_engine(spark)
    ask = lambda method, **params: respond(e, json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": params}))
    text = lambda r: r["result"]["content"][0]["text"]
    assert ask("initialize")["result"]["capabilities"] == {"tools": {}} and ask("initialize")["id"] == 7
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["list_dictionaries", "get_dictionary_description", "find_ids", "search", "find_terms"]
    assert respond(e, '{"jsonrpc": "2.0", "method": "notifications/initialized"}') == {}
    assert respond(e, "{")["error"]["code"] == -32700 and respond(e, '{"id": 1}')["error"]["code"] == -32600 and ask("other")["error"]["code"] == -32603
    found = text(ask("tools/call", name="find_ids", arguments={"labels": "Fever, nothing", "dictionary": "clinical"}))
    assert found == 'Found identifiers for terms in dictionary "clinical":\n\n**Fever**: HP:0001945\n**nothing**: '
    assert "all public dictionaries" in text(ask("tools/call", name="search", arguments={"labels": "Fever"}))
    terms = text(ask("tools/call", name="find_terms", arguments={"ids": "HP:0001945,X:1", "dictionary": "clinical"}))
    assert terms == 'Found terms for identifiers in dictionary "clinical":\n\n**HP:0001945**: Fever (from clinical)'
    assert "Found 1 dictionaries:\n\n**clinical**\nDescription: of the clinic" in text(ask("tools/call", name="list_dictionaries"))
    for name, arguments in (("none", {}), ("find_terms", {"ids": "x"}), ("find_ids", {"labels": " "}), ("find_ids", {"labels": "x", "dictionary": "unknown"})):
        bad = ask("tools/call", name=name, arguments=arguments)
        assert bad["result"]["isError"] and text(bad).startswith("Error: ")


def test_services(spark):
    """Embedding, list of models and callback against a server of this machine."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, value):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):
            self.answer(200, {"models": [{"name": "m1"}, "m2"]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.answer(400 if "bad" in body["input"] else 200, {"embeddings": [[float(len(x)), 1.0] for x in body["input"]]})

        def do_PUT(self):
            got.extend(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.answer(200, {})

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        df = spark.createDataFrame([("fever",), (None,), ("",), ("ab",)], "t string")
        assert [r.v for r in df.select(embedder.service_embedder(url, batch=1)("t").alias("v")).collect()] == [[5.0, 1.0], None, None, [2.0, 1.0]]
        assert embedder.models(url) == ["m1", "m2"]
        with pytest.raises(embedder.ClientError):
            embedder.fetch(url, ["bad"])
        export.put_results(a.annotate(spark.createDataFrame([(1, "Fever"), (2, "Headache")], "doc_id long, text string"), entries(spark, CLINICAL), dictionary(spark)), url)
        assert sorted((r["doc_id"], r["denotations"][0]["obj"]) for r in got) == [(1, "HP:0001945"), (2, "HP:0002315")]
    finally:
        server.shutdown()


def test_texts_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "one"}, {"text": "two"}]')
    (tmp_path / "b.json").write_text('{"text": "three"}')
    assert sorted(entry_file.texts_from_json(spark, str(tmp_path)).collect()) == [(1, "one"), (2, "two"), (3, "three")]
    assert sorted(r[0] for r in entry_file.text_from_file(spark, str(tmp_path)).collect()) == [1, 2]


def test_one_bad_pattern_spoils_nothing(spark):
    rows = [(1, 1, "(", "BAD", True), (2, 1, "[0-9]+", "NUMBER", True)]
    patterns = spark.createDataFrame(rows, "id long, dictionary_id long, expression string, identifier string, active boolean")
    docs = spark.createDataFrame([(1, "12 fever (34"), (2, None)], "doc_id long, text string")
    assert sorted(r.string for r in a.pattern_denotations(docs, patterns).collect()) == ["12", "34"]
    with pytest.raises(ValueError):
        edits.add_patterns(patterns, 1, [("a+", "A"), ("(", "B")])
    more = edits.add_patterns(patterns, 1, [("a+", "A"), ("b+", "B")])
    assert [(r.id, r.expression, r.active) for r in more.orderBy("id").collect()][2:] == [(3, "a+", True), (4, "b+", True)]


def test_crossings_are_counted_without_a_list_of_words(spark, data):
    """Words of a batch of texts as rows of Python objects took more than an executor's memory."""
    from termforge.functions.udfs import sentence_breaks, tokenize
    from termforge.plans.annotate_queries import QUERIES

    counted = QUERIES["fn_cross_sentence"](spark, data)
    assert "tokenize(" not in counted._jdf.queryExecution().analyzed().toString()
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").select("doc_id", tokenize("text").alias("t"), sentence_breaks("text").alias("at")).collect():
        if len(r.t) > 1:
            want[r.doc_id] = sum(any(x.begin < b < y.end for b in r["at"]) for x, y in zip(r.t, r.t[1:]))
    assert {r.doc_id: r.n for r in counted.collect()} == want and max(want.values()) > 0


def test_semantic_matches_shuffle_neither_vectors_nor_pairs(spark):
    """Each span's vector was copied to every block of rows, and all pairs came back through a shuffle, two joins and a window."""
    from termforge.functions.udfs import hash_embedder

    names = [(i, 1, x, f"X:{i}", True) for i, x in enumerate(["fever", "fevers", "storm"])]
    vectors = spark.createDataFrame(names, "id long, dictionary_id long, label string, identifier string, searchable boolean").withColumn("embedding", hash_embedder(64)("label").cast("array<float>"))
    spans = spark.createDataFrame([("Fever", "fever", "fever"), ("12.5", "12.5", "12.5"), ("ox", "ox", "ox")], "span string, norm1 string, norm2 string")
    found = a.semantic_matches(spans, vectors, hash_embedder(64), 0.45)
    assert [(r.span, r.identifier) for r in found.orderBy("identifier").collect()] == [("Fever", "X:0"), ("Fever", "X:1")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_held_knn_as_exact_knn(spark):
    import numpy as np

    from termforge.operators.knn import held_knn

    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (300, 6)).astype(float)  # few values, so that many distances tie
    x = x[np.abs(x).sum(1) > 0]
    rows = spark.createDataFrame([(int(i), int(i % 3), f"l{i}", v.tolist()) for i, v in enumerate(x)], "id long, per long, label string, vec array<float>")
    asked = spark.createDataFrame([(1000 + i, rng.normal(size=6).round(1).tolist()) for i in range(40)], "no long, vec array<double>")
    none = F.lit(None).cast("string")
    want = exact_knn(asked.withColumn("grp", none), rows.withColumn("grp", none), 4, 0.5).where("rank <= IF(per = 1, 2, 4)")
    want = {(r.query, r.id): round(r.distance, 9) for r in want.collect()}
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 6), (3, [1.0, 2.0])], asked.schema)
    k = F.when(F.col("per") == 1, 2).otherwise(4).alias("k")
    for round_bytes in (1 << 20, 4000):
        got = held_knn(asked.unionByName(odd), rows.select("*", k), 0.5, round_bytes)
        assert got.columns == ["no", "id", "label", "distance"]
        assert {(r.no, r.id): round(r.distance, 9) for r in got.collect()} == want and len(want) > 100


def test_held_knn_cuts_pairs_while_it_holds_them(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from termforge.operators import knn

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(500, 8)).astype(np.float32), rng.normal(size=(30, 8))
    y /= np.linalg.norm(y, axis=1)[:, None]
    t = pa.table({"id": np.arange(500), "per": np.arange(500) % 2, "k": np.full(500, 3), "vec": pa.array(x.tolist(), pa.list_(pa.float32()))})
    whole = [np.concatenate(c) for c in zip(*knn._Rows(t).ready().near(y, 2.0, 12))]
    assert len(whole[0]) == 30 * 2 * 3
    for name, n in (("HELD", 50), ("QUERY_TILE", 7), ("ROW_TILE", 64)):
        monkeypatch.setattr(knn, name, n)
    cut = [np.concatenate(c) for c in zip(*knn._Rows(t).ready().near(y, 2.0, 12))]
    assert all(np.array_equal(p, q) for p, q in zip(whole, cut))


def test_both_kinds_of_matches_meet_in_one_shuffle(spark):
    """Three windows, of two different keys, each shuffled all matches."""
    row = [("a", "a", "a", 1, "X:1", "a", None, None, 0.9)]
    kind = "span string, norm1 string, norm2 string, dictionary_id long, identifier string, label string, e1 string, e2 string, score double"
    found = a.best_matches(a.surface_and_semantic(spark.createDataFrame(row, kind), spark.createDataFrame(row, kind)), False)
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert found.count() == 1


def test_span_texts_that_a_table_may_hold_get_their_norms(spark):
    known = spark.createDataFrame([("fever",), ("cytokinstorm",)], "norm2 string")
    texts = spark.createDataFrame([("Fevers",), ("Cytokine storms",), ("zebra",)], "span string")
    assert {tuple(r) for r in a.with_norms(texts, known).collect()} == {("Fevers", "fevers", "fever"), ("Cytokine storms", "cytokinestorms", "cytokinstorm")}


def test_best_semantic_matches_need_no_shuffle(spark):
    from termforge.operators.knn import held_knn

    rows = [(i, 1 + i % 3, f"l{i % 4}", f"X:{i % 5}" if i % 7 else None, True, [1.0, 1.0] if i < 30 else [1.0, 0.9]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, dictionary_id long, label string, identifier string, searchable boolean, embedding array<float>")
    spans = spark.createDataFrame([("zebra", None, None)], "span string, norm1 string, norm2 string")
    embed = lambda c: F.array(F.lit(1.0), F.lit(1.0))
    one = a.semantic_matches(spans, vectors, embed, 0.5, best=True)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    all_ = a.semantic_matches(spans, vectors, embed, 0.5)
    want = a.best_matches(a.surface_and_semantic(all_.where("false"), all_), False)
    assert sorted(map(str, one.collect())) == sorted(map(str, want.select(one.columns).collect())) and one.count() == 5
    kept = ["id", "dictionary_id", "label", "identifier", F.col("embedding").alias("vec"), F.col("dictionary_id").alias("per"), F.lit(10).alias("k")]
    rounds = held_knn(spans.select("span", embed(None).alias("vec")), vectors.select(*kept), 0.5, 500, first_of=("identifier", ["dictionary_id", "label"]))
    assert {(r.identifier, r.dictionary_id, r.label) for r in rounds.collect()} == {(r.identifier, r.dictionary_id, r.label) for r in one.collect()}


def test_products_of_three_queries_choose_no_pair_too_few(monkeypatch):
    """Each query had its own products, in single precision; now three share those of a double, 16 bits each."""
    import numpy as np
    import pyarrow as pa

    from termforge.operators import knn

    rng = np.random.default_rng(7)
    for size in (1, 3, 64, 200):
        x = np.concatenate([rng.normal(size=(90, size)), np.eye(size)[:3], -np.ones((1, size))])
        x = np.concatenate([x, x[:30] + 1e-3, np.full((1, size), np.nan)]).astype(np.float32)
        t = pa.table({"id": np.arange(len(x)), "per": np.zeros(len(x), int), "k": np.full(len(x), 1000), "vec": pa.array(list(x), pa.list_(pa.float32()))})
        y = x[rng.permutation(len(x) - 1)][:76].astype(np.float64)
        y /= np.linalg.norm(y, axis=1)[:, None]
        d = 1 - y @ (x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]).T
        for tile, most in ((256, 0.55), (256, 0.02), (5, 0.9), (5, 3.0)):
            monkeypatch.setattr(knn, "QUERY_TILE", tile)
            rows = knn._Rows(t).ready()
            q, r, _ = map(np.concatenate, zip(*rows.near(y, most, 12)))
            near = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= most - 1e-9))}
            assert near <= set(zip(q.tolist(), r.tolist())) <= {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= most + 1e-9))}


def test_span_texts_come_distinct_and_spread(spark):
    """All occurrences with their norms were emitted, and their texts cut into as few partitions as their bytes call for."""
    from termforge.functions import text as kernels

    docs = spark.createDataFrame([(1, "Cytokine storms. Cytokine storms and fevers"), (2, "Fevers"), (3, None), (4, "")], "doc_id long, text string")
    known = spark.createDataFrame([("fever",)], "norm2 string")
    got = a.candidate_texts(docs, kernels.SpanRules(), known)
    held = {r.span: r.held for r in got.collect()}
    assert set(held) == {r.span for r in a.candidate_occurrences(docs, kernels.SpanRules()).collect()} and got.count() == len(held)
    assert {x for x, h in held.items() if h} == {"fevers", "Fevers", "and fevers"} & set(held) | {x for x in held if kernels.norms(x)[1] == "fever"}
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_combined_finds_norms_only_of_spans_that_entries_may_match(spark, monkeypatch):
    """All distinct spans were normed a second time, to learn which of them entries may match by surface."""
    from termforge.plans import annotate_queries as q
    from termforge.plans.golden_queries import folder

    asked, with_norms = [], a.with_norms
    monkeypatch.setattr(a, "with_norms", lambda texts, known: asked.append(texts.count()) or with_norms(texts, known))
    at = folder(spark)
    assert q.combined(spark, at).count() == 22 and 0 < asked[0] < q.span_texts(spark, at).count() / 2
