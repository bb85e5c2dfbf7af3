"""Similarity functions, joins and lookups over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions import similarity as sim
from termforge.functions import udfs
from termforge.operators import edits, lookup, ngram
from termforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def language_code(c):
    """ISO 639-3 code of a language given by any usual code; unknown ones stay."""
    # Two-letter codes and names by their three-letter code.
    codes = {"en": "eng", "de": "deu", "ger": "deu", "ja": "jpn", "ko": "kor", "fr": "fra", "fre": "fra", "es": "spa", "pt": "por", "ru": "rus", "zh": "zho", "chi": "zho"}
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    low = F.lower(F.trim(c))
    return F.coalesce(known[low], low)


def dictionaries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dictionaries").withColumn("language", language_code(F.col("language")))


def asked(s: SparkSession, d: str) -> DataFrame:
    """The query set: labels of every entry whose id is divisible by 20, with the norms delivered with the first such entry."""
    e = table(s, d, "entries").where("id % 20 = 0 AND label IS NOT NULL AND label <> ''")
    return e.groupBy("label").agg(F.min_by(F.struct("norm1", "norm2"), "id").alias("n")).select("label", "n.norm1", "n.norm2")


_ASKED = """asked AS (SELECT label, n.norm1, n.norm2 FROM (SELECT label, arg_min({norm1: norm1, norm2: norm2}, id) AS n FROM entries
    WHERE id % 20 = 0 AND label IS NOT NULL AND label <> '' GROUP BY label))"""
_SCOPE = """scope AS (SELECT e.id AS entry_id, dictionary_id, label AS entry_label, identifier, norm1 AS e1, norm2 AS e2, threshold,
    CASE lower(trim(language)) WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'ja' THEN 'jpn' ELSE lower(trim(language)) END AS language
    FROM entries e JOIN dictionaries d ON d.id = e.dictionary_id WHERE mode <> 2)"""
_TRI = "list_transform(range(1, length({0}) + 1), lambda i: substr(right({0}, 1) || {0} || left({0}, 1), i, 3))"
_BI = "list_transform(range(1, length({0}) + 1), lambda i: substr({0} || left({0}, 1), i, 2))"
_UNI = "list_transform(range(1, length({0}) + 1), lambda i: substr({0}, i, 1))"
_PBI = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"


def _jac(grams: str, a: str, b: str) -> str:
    x, y = grams.format(a), grams.format(b)
    return f"(CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) ELSE 0.0 END)"


def _cos(grams: str, a: str, b: str) -> str:
    x, y = grams.format(a), grams.format(b)
    count = lambda xs: f"len(list_filter({xs}, lambda z: z = g))"
    dot = f"list_sum(list_transform(list_intersect({x}, {y}), lambda g: CAST({count(x)} * {count(y)} AS DOUBLE)))"
    norm = lambda xs: f"sqrt(list_sum(list_transform(list_distinct({xs}), lambda g: CAST({count(xs)} * {count(xs)} AS DOUBLE))))"
    return f"(CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN coalesce({dot}, 0) / ({norm(x)} * {norm(y)}) ELSE 0.0 END)"


def _sim(a: str, b: str, a1: str, b1: str, a2: str, b2: str, grams: str = _TRI) -> str:
    s, one, two = _jac(grams, a, b), _jac(grams, a1, b1), _jac(grams, a2, b2)
    return f"(CASE WHEN {a2} = '' AND {b2} = '' THEN ({s} + {one}) / 2 ELSE ({s} + {one} + {two} * 10) / 12 END)"


def _jp(a: str, b: str) -> str:
    return f"({_cos(_UNI, a, b)} * 0.7 + {_cos(_PBI, a, b)} * 0.3)"


_S6 = ("label", "entry_label", "norm1", "e1", "norm2", "e2")
_SCORE = f"(CASE language WHEN 'kor' THEN {_sim(*_S6, grams=_BI)} WHEN 'jpn' THEN {_jp('label', 'entry_label')} ELSE {_sim(*_S6)} END)"
_SOFT = f"""{_ASKED}, {_SCOPE}, m AS (SELECT *, {_SCORE} AS score FROM asked JOIN scope ON norm2 = e2 WHERE e1 IS NOT NULL AND norm1 IS NOT NULL AND norm2 <> ''),
    soft AS (SELECT * FROM m WHERE score >= threshold)"""
_TOP = "top AS (SELECT *, max(score) OVER (PARTITION BY label) AS best FROM soft)"


def soft(s: SparkSession, d: str) -> DataFrame:
    return lookup.match_soft(asked(s, d), table(s, d, "entries"), dictionaries(s, d))


# functions on labels
grams = lambda g, c: lambda s, d: table(s, d, "entries").select("id", F.array_join(g(F.col(c)), "|").alias("grams"))
add("fn_unigrams", grams(sim.unigrams, "label"), f"SELECT id, coalesce(array_to_string({_UNI.format('label')}, '|'), '') AS grams FROM entries")
add("fn_circular_bigram", grams(sim.circular_bigrams, "label"), f"SELECT id, coalesce(array_to_string({_BI.format('label')}, '|'), '') AS grams FROM entries")
add("fn_circular_trigram", grams(sim.circular_trigrams, "label"), f"SELECT id, coalesce(array_to_string({_TRI.format('label')}, '|'), '') AS grams FROM entries")
add(
    "fn_jaccard",
    lambda s, d: table(s, d, "entries").where("label IS NOT NULL AND norm1 IS NOT NULL").select("id", F.round(sim.jaccard(sim.circular_trigrams(F.col("label")), sim.circular_trigrams(F.col("norm1"))), 6).alias("j")),
    f"SELECT id, round({_jac(_TRI, 'label', 'norm1')}, 6) AS j FROM entries WHERE label IS NOT NULL AND norm1 IS NOT NULL",
)
_FULL = "label IS NOT NULL AND identifier IS NOT NULL AND norm1 IS NOT NULL AND norm2 IS NOT NULL"
six = [F.col, ("label", "identifier", "norm1", "norm2", "norm2", "norm1")]
score = lambda g: lambda s, d: table(s, d, "entries").where(_FULL).select("id", F.round(g(*[F.col(c) for c in six[1]]), 6).alias("score"))
add("fn_str_sim_3gram", score(sim.str_sim_3gram), f"SELECT id, round({_sim(*six[1])}, 6) AS score FROM entries WHERE {_FULL}")
add("fn_str_sim_2gram", score(sim.str_sim_2gram), f"SELECT id, round({_sim(*six[1], grams=_BI)}, 6) AS score FROM entries WHERE {_FULL}")
add("fn_str_sim_jp", score(lambda a, b, *_: sim.str_sim_jp(a, b)), f"SELECT id, round({_jp('label', 'identifier')}, 6) AS score FROM entries WHERE {_FULL}")
add("fn_sim_dispatch", lambda s, d: soft(s, d).select("label", "entry_id", F.round("score", 6).alias("score")), f"WITH {_SOFT} SELECT label, entry_id, round(score, 6) AS score FROM soft")
_NUM = """list_transform(range(1, len(g) + 1), lambda i: g[i] || '#' || len(list_filter(g[1:i], lambda x: x = g[i])))"""
_PAD = "list_transform(range(1, length(p) - 2), lambda i: substr(p, i, 4))"
add(
    "fn_strsim_ngrams",
    lambda s, d: table(s, d, "entries").where("length(norm2) > 0").select("id", F.array_join(sim.numbered_ngrams(F.col("norm2")), "|").alias("grams")),
    f"""SELECT id, array_to_string({_NUM}, '|') AS grams FROM (SELECT id, {_PAD} AS g FROM (SELECT id, repeat(chr(1), 3) || norm2 || repeat(chr(1), 3) AS p FROM entries WHERE length(norm2) > 0))""",
)


def features(s: SparkSession, d: str) -> DataFrame:
    a, b = sim.circular_trigrams(F.col("norm1")), sim.circular_trigrams(F.col("norm2"))
    rows = table(s, d, "entries").where("length(norm1) > 0 AND length(norm2) > 0").select("id", F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b"))
    x, y = F.col("a"), F.col("b")
    return rows.select("id", F.round(sim.feature_cosine(x, y), 6).alias("cosine"), F.round(sim.feature_overlap(x, y), 6).alias("overlap"), F.round(sim.jaccard(x, y), 6).alias("jaccard"))


add(
    "fn_strsim_measures",
    features,
    f"""WITH f AS (SELECT id, list_distinct({_TRI.format("norm1")}) AS a, list_distinct({_TRI.format("norm2")}) AS b FROM entries WHERE length(norm1) > 0 AND length(norm2) > 0),
    i AS (SELECT id, len(list_intersect(a, b)) AS i, len(a) AS a, len(b) AS b FROM f)
    SELECT id, round(i / sqrt(a * b), 6) AS cosine, round(i / least(a, b), 6) AS overlap, round(i / (a + b - i), 6) AS jaccard FROM i""",
)
_I = f"""WITH f AS (SELECT id, list_distinct({_TRI.format("norm1")}) AS a, list_distinct({_TRI.format("norm2")}) AS b FROM entries WHERE length(norm1) > 0 AND length(norm2) > 0),
    i AS (SELECT id, len(list_intersect(a, b)) AS i, len(a) AS a, len(b) AS b FROM f)"""
for _name, _sql in (("cosine", "i / sqrt(a * b)"), ("overlap", "i / least(a, b)"), ("jaccard", "i / (a + b - i)")):
    add(f"fn_strsim_{_name}", lambda s, d, n=_name: features(s, d).select("id", n), f"{_I} SELECT id, round({_sql}, 6) AS {_name} FROM i")
add("fn_filename", lambda s, d: table(s, d, "entries").select("id", udfs.filename(F.col("label")).alias("name")), r"SELECT id, regexp_replace(label, '[\s]+', '_', 'g') AS name FROM entries")
add("fn_language_code", lambda s, d: dictionaries(s, d).select("id", "language"), "SELECT id, CASE lower(trim(language)) WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'ja' THEN 'jpn' ELSE lower(trim(language)) END AS language FROM dictionaries")
add("fn_normalize1", lambda s, d: table(s, d, "entries").where("label IS NOT NULL").select("id", udfs.normalize1("label").alias("norm1")))
add("fn_normalize2", lambda s, d: table(s, d, "entries").where("label IS NOT NULL").select("id", udfs.normalize2("label").alias("norm2")))
add("fn_tokenize", lambda s, d: table(s, d, "documents").select("doc_id", F.inline(udfs.tokenize("text"))))
add("fn_sentence_break", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(udfs.sentence_breaks("text")).alias("at")))
add("fn_normalize_ja", lambda s, d: _normalized(s, d, "jpn"))
add("fn_normalize_ko", lambda s, d: _normalized(s, d, "kor"))
add("fn_normalize_str", lambda s, d: table(s, d, "entries").where("label IS NOT NULL").select("id", udfs.normalize_str("label").alias("label")))
add("dml_mode_transitions", lambda s, d: _transitions(s, d), """SELECT id, CASE WHEN mode = 2 THEN 0 WHEN mode = 0 AND id % 2 = 0 THEN 1 WHEN mode = 0 THEN 2 WHEN mode = 6 THEN 1 ELSE mode END AS mode,
    CASE WHEN mode = 2 OR mode = 6 OR (mode = 0 AND id % 2 = 0) THEN true WHEN mode = 0 THEN false ELSE searchable END AS searchable FROM entries""")
add("fn_abbr_type", lambda s, d: _abbreviations(s, d))
add("fn_decapitalize", lambda s, d: table(s, d, "entries").where("label IS NOT NULL").select("id", udfs.decapitalize("label").alias("label")))
add("fn_simple_tokenize", lambda s, d: table(s, d, "entries").select("id", F.inline(udfs.simple_tokens("label"))))


def _normalized(s: SparkSession, d: str, language: str) -> DataFrame:
    """Norms of the labels of one language's dictionaries."""
    ids = dictionaries(s, d).where(F.col("language") == language).select(F.col("id").alias("dictionary_id"))
    e = table(s, d, "entries").where("label IS NOT NULL").join(ids, "dictionary_id", "left_semi")
    return e.select("id", udfs.normalize1("label").alias("norm1"), udfs.normalize2("label").alias("norm2"))


def _transitions(s: SparkSession, d: str) -> DataFrame:
    """Gray entries to white and black, black ones back, expanded ones confirmed, each by the mode it had at first."""
    e = table(s, d, "entries").select("id", "mode", "searchable")
    ids = lambda c: e.where(c).select("id")
    e1 = edits.cancel_black(edits.confirm(e, ids("mode = 6")), ids("mode = 2"))
    return edits.turn_to_black(edits.turn_to_white(e1, ids("mode = 0 AND id % 2 = 0")), ids("mode = 0 AND id % 2 = 1"))


def _abbreviations(s: SparkSession, d: str) -> DataFrame:
    """Each label against the initials of its own words and against its identifier."""
    e = table(s, d, "entries").where("label IS NOT NULL AND identifier IS NOT NULL AND label <> ''")
    initials = F.array_join(F.transform(F.split("label", "[- ]"), lambda w: F.left(w, F.lit(1))), "")
    return e.select("id", udfs.abbreviation_type(initials, F.col("label")).alias("by_initials"), udfs.abbreviation_type("identifier", "label").alias("by_identifier"))


# joins and lookups
add("join_norm2", lambda s, d: _norm2(s, d), f"WITH {_ASKED}, {_SCOPE} SELECT label, entry_id, identifier FROM asked JOIN scope ON norm2 = e2")


def _norm2(s: SparkSession, d: str) -> DataFrame:
    a, e = asked(s, d), lookup.scoped(table(s, d, "entries"), dictionaries(s, d))
    return a.join(e, a["norm2"] == e["e2"]).select("label", "entry_id", "identifier")


add(
    "join_label_exact",
    lambda s, d: lookup.match_exact(asked(s, d), table(s, d, "entries"), dictionaries(s, d)).select("label", "entry_id", "identifier", "score"),
    f"WITH {_ASKED}, {_SCOPE} SELECT label, entry_id, identifier, CAST(1.0 AS DOUBLE) AS score FROM asked JOIN scope ON label = entry_label",
)


def terms(verbose: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        ids = table(s, d, "entries").where("id % 20 = 0").select("identifier")
        e = table(s, d, "entries").where("label IS NOT NULL")
        found = lookup.find_terms(ids, e, table(s, d, "dictionaries"), verbose)
        if not verbose:
            return found
        return found.select("identifier", F.array_join(F.transform("labels", lambda x: F.concat(x["label"], F.lit("@"), x["dictionary"])), "|").alias("labels"))

    return run


_TERMS = """SELECT identifier, {0} FROM entries e JOIN dictionaries d ON d.id = e.dictionary_id WHERE label IS NOT NULL
    AND identifier IN (SELECT identifier FROM entries WHERE id % 20 = 0) GROUP BY 1"""
add("op_find_terms", terms(True), _TERMS.format("string_agg(label || '@' || name, '|' ORDER BY label, name) AS labels"))
add("op_find_terms_first", terms(False), "WITH t AS (" + _TERMS.format("min({label: label, dictionary: name}) AS m") + ") SELECT identifier, m.label AS label, m.dictionary AS dictionary FROM t")
add(
    "join_identifier",
    lambda s, d: table(s, d, "entries").where("id % 20 = 0").select("identifier").distinct().join(table(s, d, "entries").select("id", "label", "identifier", "mode"), "identifier"),
    "SELECT identifier, id, label, mode FROM entries WHERE identifier IN (SELECT identifier FROM entries WHERE id % 20 = 0)",
)
add("agg_max_score", lambda s, d: soft(s, d).groupBy("label").agg(F.round(F.max("score"), 6).alias("best")), f"WITH {_SOFT} SELECT label, round(max(score), 6) AS best FROM soft GROUP BY 1")
add("top_ties", lambda s, d: lookup.top_ties(soft(s, d)).select("label", "entry_id", F.round("score", 6).alias("score")), f"WITH {_SOFT}, {_TOP} SELECT label, entry_id, round(score, 6) AS score FROM top WHERE score = best")
_ORDER = "row_number() OVER (PARTITION BY label ORDER BY score DESC, dictionary_id, identifier NULLS FIRST, entry_label, entry_id)"
add(
    "top_order",
    lambda s, d: lookup.top_order(soft(s, d)).select("label", "entry_id", F.round("score", 6).alias("score"), "rank"),
    f"WITH {_SOFT} SELECT label, entry_id, round(score, 6) AS score, CAST({_ORDER} AS INTEGER) AS rank FROM soft",
)


def found(**options):
    def run(s: SparkSession, d: str) -> DataFrame:
        out = lookup.find_ids(asked(s, d), table(s, d, "entries"), dictionaries(s, d), entry_tags=table(s, d, "entry_tags"), tag_table=table(s, d, "tags"), **options)
        return out.select("label", F.array_join("identifiers", "|").alias("identifiers"))

    return run


def _ids_sql(ctes: str, source: str) -> str:
    """Identifiers in the order of their first occurrence by rank."""
    return f"""WITH {ctes}, r AS (SELECT label, identifier, {_ORDER} AS rank FROM {source}), f AS (SELECT label, identifier, min(rank) AS rank FROM r WHERE identifier IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT label, string_agg(identifier, '|' ORDER BY rank) AS identifiers FROM f GROUP BY 1) SELECT label, coalesce(identifiers, '') AS identifiers FROM asked LEFT JOIN g USING (label)"""


def _near_sql(strings: str, least: float = 0.85) -> str:
    """Pairs of an asked norm and one of the strings by trigrams: counted over all shared trigrams, without any filter."""
    grams = lambda source: f"SELECT v, len(g) AS n, unnest(g) AS gram FROM (SELECT v, list_distinct({_TRI.format('v')}) AS g FROM (SELECT DISTINCT v FROM ({source}) WHERE length(v) > 0))"
    return f"""ga AS ({grams("SELECT norm2 AS v FROM asked")}), gb AS ({grams(strings)}),
    gc AS (SELECT ga.v AS "left", gb.v AS "right", count(*) AS c, any_value(ga.n) AS na, any_value(gb.n) AS nb FROM ga JOIN gb USING (gram) GROUP BY 1, 2),
    near AS (SELECT "left", "right", c / (na + nb - c) AS similarity FROM gc WHERE c / (na + nb - c) >= {least})"""


add("op_find_ids", found(), _ids_sql(f"{_SOFT}, {_TOP}, t AS (SELECT * FROM top WHERE score = best)", "t"))
add("op_find_ids_superfluous", found(superfluous=True), _ids_sql(_SOFT, "soft"))
_EXACT = f"{_ASKED}, {_SCOPE}, x AS (SELECT *, CAST(1.0 AS DOUBLE) AS score FROM asked JOIN scope ON label = entry_label)"
add("op_find_ids_exact", found(threshold=1.0), _ids_sql(_EXACT, "x"))
_TAGGED = "entry_id IN (SELECT x.entry_id FROM entry_tags x JOIN tags t ON t.id = x.tag_id WHERE t.value IN ('Chemistry', 'medicine'))"
add("op_find_ids_tags", found(threshold=1.0, tags=["Chemistry", "medicine"]), _ids_sql(_EXACT.replace("ON label = entry_label", f"ON label = entry_label AND {_TAGGED}"), "x"))
add("op_search_term", lambda s, d: soft(s, d).select("label", "dictionary_id", "identifier", "entry_label", F.round("score", 6).alias("score")), f"WITH {_SOFT} SELECT label, dictionary_id, identifier, entry_label, round(score, 6) AS score FROM soft")
add(
    "snk_csv_first",
    lambda s, d: lookup.first_ids(lookup.find_ids(asked(s, d), table(s, d, "entries"), dictionaries(s, d), threshold=1.0)),
    f"""WITH {_EXACT}, r AS (SELECT label, identifier, {_ORDER} AS rank FROM x WHERE identifier IS NOT NULL), f AS (SELECT label, arg_min(identifier, rank) AS identifier FROM r GROUP BY 1)
    SELECT label, coalesce(identifier, '') AS identifier FROM asked LEFT JOIN f USING (label)""",
)
add(
    "join_ngram",
    lambda s, d: ngram.similarity_join(asked(s, d), "norm2", table(s, d, "entries").where("mode IN (0, 1)"), "norm2", 0.85).select("left", "right", F.round("similarity", 6).alias("similarity")),
    f"""WITH {_ASKED}, {_near_sql("SELECT norm2 AS v FROM entries WHERE mode IN (0, 1)")} SELECT "left", "right", round(similarity, 6) AS similarity FROM near""",
)
add(
    "op_find_ids_ngram",
    lambda s, d: _ngram_ids(s, d),
    _ids_sql(
        f"""{_ASKED}, {_SCOPE}, {_near_sql("SELECT e2 AS v FROM scope WHERE e1 IS NOT NULL")}, m AS (SELECT *, {_SCORE} AS score FROM asked JOIN near ON norm2 = "left"
        JOIN scope ON e2 = "right" WHERE e1 IS NOT NULL AND norm1 IS NOT NULL), soft AS (SELECT * FROM m WHERE score >= 0.85), {_TOP}, t AS (SELECT * FROM top WHERE score = best)""",
        "t",
    ),
)
add("ngram_postings", lambda s, d: ngram.postings(table(s, d, "entries").where("mode IN (0, 1)"), "norm2"), f"SELECT norm2, CAST(len(g) AS INTEGER) AS n_grams, unnest(g) AS gram FROM (SELECT norm2, list_distinct({_TRI.format('norm2')}) AS g FROM (SELECT DISTINCT norm2 FROM entries WHERE mode IN (0, 1) AND length(norm2) > 0))")


def _ngram_ids(s: SparkSession, d: str) -> DataFrame:
    out = lookup.find_ids(asked(s, d), table(s, d, "entries"), dictionaries(s, d), threshold=0.85, ngram=True)
    return out.select("label", F.array_join("identifiers", "|").alias("identifiers"))


# edits
_KEYED = "PARTITION BY dictionary_id, label, identifier"
add("dml_dedup", lambda s, d: edits.deduplicated(table(s, d, "entries")).select("id"), f"SELECT id FROM (SELECT id, row_number() OVER ({_KEYED} ORDER BY id) AS r FROM entries) WHERE r = 1")
add("join_self_ineq_dedup", lambda s, d: table(s, d, "entries").select("id").join(edits.deduplicated(table(s, d, "entries")).select("id"), "id", "left_anti"), f"SELECT id FROM (SELECT id, row_number() OVER ({_KEYED} ORDER BY id) AS r FROM entries) WHERE r > 1")


def emptied(mode):
    return lambda s, d: edits.empty_entries(table(s, d, "entries"), table(s, d, "entry_tags"), table(s, d, "tags"), 31, mode).entries.select("id", "mode", "searchable")


add("dml_empty_entries", emptied(None), "SELECT id, mode, searchable FROM entries WHERE dictionary_id IS DISTINCT FROM 31")
add("dml_empty_entries_gray", emptied(0), "SELECT id, mode, searchable FROM entries WHERE NOT coalesce(dictionary_id = 31 AND mode = 0, false)")
add("dml_empty_entries_black", emptied(2), "SELECT id, CASE WHEN dictionary_id = 31 AND mode = 2 THEN 0 ELSE mode END AS mode, searchable FROM entries")


def transition(change, cond: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        e = table(s, d, "entries").select("id", "mode", "searchable")
        return change(e, e.where(cond).select("id"))

    return run


_EVERY5 = "id % 5 = 0"
add("dml_mode_to_white", transition(edits.turn_to_white, f"{_EVERY5} AND mode = 0"), f"SELECT id, CASE WHEN {_EVERY5} AND mode = 0 THEN 1 ELSE mode END AS mode, searchable OR coalesce({_EVERY5} AND mode = 0, false) AS searchable FROM entries")
add("dml_mode_to_black", transition(edits.turn_to_black, f"{_EVERY5} AND mode = 0"), f"SELECT id, CASE WHEN {_EVERY5} AND mode = 0 THEN 2 ELSE mode END AS mode, searchable AND NOT coalesce({_EVERY5} AND mode = 0, false) AS searchable FROM entries")
add("dml_mode_cancel_black", transition(edits.cancel_black, "mode = 2"), "SELECT id, CASE WHEN mode = 2 THEN 0 ELSE mode END AS mode, searchable OR coalesce(mode = 2, false) AS searchable FROM entries")
add("dml_mode_confirm", transition(edits.confirm, "mode = 6"), "SELECT id, CASE WHEN mode = 6 THEN 1 ELSE mode END AS mode, searchable OR coalesce(mode = 6, false) AS searchable FROM entries")
add("dml_mode_undo", transition(edits.undo, "true"), "SELECT id, CASE WHEN mode = 2 THEN 0 ELSE mode END AS mode, searchable OR coalesce(mode = 2, false) AS searchable FROM entries WHERE mode IS DISTINCT FROM 1")
by_tags = lambda i: lambda s, d: edits.searchable_by_tags(table(s, d, "entries"), table(s, d, "entry_tags"), table(s, d, "tags"), ["Chemistry", "medicine"])[i]
_NOW = _TAGGED.replace("entry_id IN", "id IN", 1)
add("dml_searchable_by_tags", lambda s, d: by_tags(0)(s, d).select("id", "searchable"), f"SELECT id, {_NOW} AS searchable FROM entries")
add("dml_searchable_by_tags_counts", by_tags(1), f"SELECT count(*) FILTER (searchable AND NOT {_NOW}) AS made_unsearchable, count(*) FILTER (NOT searchable AND {_NOW}) AS made_searchable FROM entries")
add("dml_sync_semantic", lambda s, d: edits.sync_semantic(table(s, d, "semantic_dict_16"), table(s, d, "entries")).select("id", "label", "identifier", "searchable"), "SELECT id, e.label, e.identifier, e.searchable FROM semantic_dict_16 v JOIN entries e USING (id)")
add("dml_ctas_semantic", lambda s, d: edits.semantic_table(table(s, d, "entries"), 145).select("id", "label", "searchable"), "SELECT id, label, searchable FROM entries WHERE dictionary_id = 145 AND embedding IS NOT NULL")


def upserted(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "semantic_dict_16")
    new = old.where("id % 3 = 0").withColumns({"label": F.upper("label"), "searchable": F.lit(None).cast("boolean")})
    return edits.upsert(old, new).select("id", "label", "searchable")


add("dml_upsert_semantic", upserted, "SELECT id, CASE WHEN id % 3 = 0 THEN upper(label) ELSE label END AS label, CASE WHEN id % 3 = 0 THEN true ELSE searchable END AS searchable FROM semantic_dict_16")


def inserted(i: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        """Dictionary 7 loaded into dictionary 31 with one tag per entry."""
        e = table(s, d, "entries").where("label IS NOT NULL AND identifier IS NOT NULL")
        new = e.where("dictionary_id = 7").select(F.col("id").alias("line_no"), "label", "identifier", F.array(F.concat(F.lit("batch"), (F.col("id") % 3).cast("string"))).alias("tags"), "norm1", "norm2")
        return edits.bulk_insert(table(s, d, "entries"), new, table(s, d, "tags"), 31)[i]

    return run


_NEW = """n AS (SELECT min(id) AS line_no, label, identifier FROM entries WHERE dictionary_id = 7 AND label IS NOT NULL AND identifier IS NOT NULL GROUP BY 2, 3),
    k AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM entries o WHERE o.dictionary_id = 31 AND o.label = n.label AND o.identifier = n.identifier)),
    x AS (SELECT (SELECT max(id) FROM entries) + row_number() OVER (ORDER BY line_no) AS id, line_no, label, identifier FROM k)"""
add("dml_bulk_insert", lambda s, d: inserted(0)(s, d).select("id", "dictionary_id", "label", "identifier", "label_length", "mode"), f"WITH {_NEW} SELECT id, CAST(31 AS BIGINT) AS dictionary_id, label, identifier, CAST(length(label) AS INTEGER) AS label_length, 0 AS mode FROM x")
add("dml_bulk_insert_tags", inserted(1), f"WITH {_NEW}, v AS (SELECT DISTINCT 'batch' || line_no % 3 AS value FROM x) SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY value) AS id, CAST(31 AS BIGINT) AS dictionary_id, value FROM v")


def created(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "entries")
    wanted = e.where("dictionary_id = 7").select(F.lit(31).cast("long").alias("dictionary_id"), F.concat(F.lit(" "), "label").alias("label"), "identifier")
    return edits.create_entries(e, wanted, F.lower("label"), F.lower("label")).select("dictionary_id", "label", "identifier", "mode", "dirty")


add(
    "dml_entry_create",
    created,
    """WITH w AS (SELECT DISTINCT trim(label) AS label, trim(identifier) AS identifier FROM entries WHERE dictionary_id = 7)
    SELECT CAST(31 AS BIGINT) AS dictionary_id, label, identifier, 1 AS mode, true AS dirty FROM w WHERE label <> '' AND identifier <> ''
    AND NOT EXISTS (SELECT 1 FROM entries o WHERE o.dictionary_id = 31 AND o.label = w.label AND o.identifier = w.identifier)""",
)


def pattern_edit(s: SparkSession, d: str) -> DataFrame:
    from termforge.plans.filter_queries import patterns

    p = edits.empty_patterns(edits.toggle_patterns(patterns(s, d), [1, 2, 5]), 7)
    return edits.patterns_num(p.where("active"))


def _patterns_sql() -> str:
    from termforge.plans.filter_queries import PATTERNS_SQL

    return f"SELECT dictionary_id, count(*) AS patterns_num FROM {PATTERNS_SQL} WHERE (active <> (id IN (1, 2, 5))) AND dictionary_id <> 7 GROUP BY 1"


add("dml_patterns", pattern_edit, _patterns_sql())


def tag_edit(s: SparkSession, d: str) -> DataFrame:
    add_, remove, kept = edits.update_tags(table(s, d, "tags"), table(s, d, "entry_tags"), 31, ["Chemistry", "brand_new"])
    one = lambda df, what: df.select("value", F.lit(what).alias("what"))
    return one(add_, "add").unionByName(one(remove, "remove")).unionByName(one(kept, "in use"))


add(
    "dml_tags",
    tag_edit,
    """WITH h AS (SELECT id, value FROM tags WHERE dictionary_id = 31) SELECT value, 'add' AS what FROM (SELECT unnest(['Chemistry', 'brand_new']) AS value) WHERE value NOT IN (SELECT value FROM h)
    UNION ALL SELECT value, CASE WHEN id IN (SELECT tag_id FROM entry_tags) THEN 'in use' ELSE 'remove' END FROM h WHERE value NOT IN ('Chemistry', 'brand_new')""",
)
add("op_compile", lambda s, d: edits.compile_dictionary(table(s, d, "entries")).select("id", "dirty"), "SELECT id, dirty AND NOT coalesce(mode = 1, false) AS dirty FROM entries")
add("op_reset_searchable", lambda s, d: edits.reset_searchable(table(s, d, "entries")).select("id", "searchable"), "SELECT id, coalesce(mode <> 2, true) AS searchable FROM entries")
add(
    "op_expand_synonyms",
    lambda s, d: edits.expand_synonyms(table(s, d, "entries"), F.lit("2024-01-01").cast("timestamp_ntz")).select("dictionary_id", "label", "identifier", "mode"),
    """WITH f AS (SELECT dictionary_id, identifier, min(label) AS label FROM entries WHERE mode IN (0, 1) AND created_at < TIMESTAMP '2024-01-01' AND identifier IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)
    SELECT dictionary_id, label || '--dummy-synonym-' || i AS label, identifier, 6 AS mode FROM f, range(2) t(i)""",
)
add(
    "src_scan_dictionary",
    lambda s, d: lookup.find_dictionaries(table(s, d, "dictionaries"), _names(s, d)).select("pos", "id", "name"),
    "SELECT CAST(n AS INTEGER) AS pos, id, name FROM (SELECT id, name, unnest([row_number() OVER (ORDER BY id DESC) - 1, 240 + row_number() OVER (ORDER BY id) - 1]) AS n FROM dictionaries)",
)


def _names(s: SparkSession, d: str) -> list[str]:
    """A request that names each of the 240 dictionaries twice."""
    names = [r.name for r in table(s, d, "dictionaries").orderBy("id").select("name").collect()]
    return names[::-1] + names
