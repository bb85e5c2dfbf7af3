"""Annotation of all documents with the public dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.functions.resolve import consolidated, ordered, without_crossings, without_embedded
from termforge.functions.udfs import crossings, hash_embedder, tokenize, worth_embedding
from termforge.functions.vectors import usable
from termforge.operators import annotate as a
from termforge.plans.lookup_queries import dictionaries
from termforge.session import written
from termforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def public(s: SparkSession, d: str) -> DataFrame:
    return dictionaries(s, d).where("public")


# Patterns in the place of a table of patterns: symbols of genes, temperatures, doses.
PATTERNS = [(1, "[A-Z]{2,5}[0-9]+", "GENE"), (2, "[0-9]+ °C", "TEMPERATURE"), (3, "(?<dose>[0-9.]+) ?(mg|µg)/[a-zA-Z]+", "DOSE"), (4, "[0-9]+", "OFF")]


def patterns(s: SparkSession) -> DataFrame:
    rows = [(i, 1, e, o, o != "OFF") for i, e, o in PATTERNS]
    return s.createDataFrame(rows, "id long, dictionary_id long, expression string, identifier string, active boolean")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def annotated(options: a.Options | None = None, with_patterns: bool = False):
    def run(s: SparkSession, d: str) -> DataFrame:
        p = patterns(s) if with_patterns else None
        return a.exploded(a.annotate(docs(s, d), table(s, d, "entries"), public(s, d), options, p))

    return run


def spans(s: SparkSession, d: str) -> DataFrame:
    return a.candidate_occurrences(docs(s, d), a.span_rules(public(s, d), a.Options()))


def surface(s: SparkSession, d: str) -> DataFrame:
    known = a.compiled_entries(table(s, d, "entries"), public(s, d))
    found = a.candidate_occurrences(docs(s, d), a.span_rules(public(s, d), a.Options()), known).select("span", "norm1", "norm2").distinct()
    return a.surface_matches(found, known, a.Options()).select("span", "dictionary_id", "identifier", "label", "score")


def kept(s: SparkSession, d: str) -> DataFrame:
    """Dictionaries whose context is near enough to each text, the texts embedded by the stand-in."""
    v = docs(s, d).where("text IS NOT NULL AND text <> ''").select("doc_id", hash_embedder(64)("text").alias("vec"))
    c = public(s, d).select(F.col("id").alias("dictionary_id"), F.when(usable(F.col("context_embedding"), 64), F.col("context_embedding")).alias("context_embedding"))
    return a.context_kept(v, c, 0.0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_dictionaries"))


def _steps(*steps):
    """A query that stops after some of the steps which resolve overlaps."""

    def choose(found):
        for step in steps:
            found = step(found)
        return found

    def run(s: SparkSession, d: str) -> DataFrame:
        options = a.Options(abbreviation=False)
        return a.exploded(a.annotate(docs(s, d), table(s, d, "entries"), public(s, d), options, patterns(s), choose=choose)).select("doc_id", "begin", "end", "obj", "score")

    return run


def unique_spans(s: SparkSession, d: str) -> DataFrame:
    """All distinct candidate spans, also those that no entry matches by surface."""
    return spans(s, d).select("span", "norm1", "norm2").distinct()


def vectors(s: SparkSession, d: str) -> DataFrame:
    return a.vectors_of(table(s, d, "semantic_dict_16"), table(s, d, "entries"))


def span_texts(s: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """The texts of all distinct candidate spans, and whether entries may match them by surface. A span's norms follow from its text, as its words are those of the text around it, so they needn't be shuffled."""
    none = F.lit(None).cast("string")
    return a.candidate_texts(docs(s, d), a.span_rules(public(s, d), a.Options()), known).select("span", none.alias("norm1"), none.alias("norm2"), "held")


def semantic(s: SparkSession, d: str) -> DataFrame:
    """All candidate spans of all documents, embedded by the stand-in, against the vectors of all dictionaries, one by one."""
    m = a.semantic_matches(span_texts(s, d), vectors(s, d), hash_embedder(64), 0.45)
    return m.select("span", "dictionary_id", "identifier", F.round("score", 6).alias("score"))


def combined(s: SparkSession, d: str) -> DataFrame:
    """Best matches of all candidate spans by surface and by vectors together."""
    known = written(a.compiled_entries(table(s, d, "entries"), public(s, d)), "compiled")
    texts = written(span_texts(s, d, known), "spans")
    # norms follow from the text, so that matches of both kinds are told apart by it alone
    some = written(a.with_norms(texts.where("held"), known), "some_spans")
    surface = a.surface_matches(some, known, a.Options()).withColumns({c: F.lit(None).cast("string") for c in ("norm1", "norm2")})
    surface = written(surface, "surface")
    near = lambda x, best: a.semantic_matches(x, vectors(s, d), hash_embedder(64), 0.45, best=best)
    with_both, without = a.held_apart(texts, surface)
    both = a.best_matches(a.surface_and_semantic(surface, near(with_both, False)), False).unionByName(near(without, True))
    return both.select("span", "dictionary_id", "identifier", F.round("score", 6).alias("score"))


def overlapping(s: SparkSession, d: str) -> DataFrame:
    """Denotations before resolution that begin within one before them, by a running maximum of ends instead of a join."""
    found = _steps(ordered)(s, d)
    before = Window.partitionBy("doc_id").orderBy("begin", F.desc("end"), "obj").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("end").over(before)).where("begin < reach").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def crossing(s: SparkSession, d: str) -> DataFrame:
    """Neighbouring tokens with a sentence break between them, per document."""
    return docs(s, d).where("text IS NOT NULL").select("doc_id", crossings("text").alias("n")).where("n IS NOT NULL")


QUERIES |= {
    "ann_tokens": lambda s, d: docs(s, d).select("doc_id", F.inline(tokenize("text"))).select("doc_id", "begin", "end", "token"),
    "ann_embed": lambda s, d: unique_spans(s, d).select("span").distinct().where(worth_embedding(F.col("span"))).select("span", hash_embedder(16)("span").alias("embedding")),
    "ann_semantic": semantic,
    "ann_combine": combined,
    "ann_denotations": _steps(),
    "ann_sort": _steps(ordered),
    "srt_denotations": _steps(ordered),
    "ann_consolidate": _steps(ordered, consolidated),
    "ann_boundary": _steps(ordered, consolidated, without_crossings),
    "ann_embedded": _steps(ordered, consolidated, without_crossings, without_embedded),
    "ann_abbr_find": lambda s, d: annotated()(s, d).where("abbr_type IS NOT NULL").select("string", "obj", "abbr_type").distinct(),
    "ann_abbr_emit": lambda s, d: annotated()(s, d).where("abbr_type IS NOT NULL").select("doc_id", "begin", "end", "obj", "abbr_type"),
    "ann_reset": lambda s, d: annotated(a.Options(abbreviation=False))(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    "join_interval_overlap": overlapping,
    "fn_cross_sentence": crossing,
}
QUERIES |= {
    "op_annotation_batch": annotated(),
    "ann_superfluous": annotated(a.Options(longest=False, superfluous=True)),
    "ann_verbose_exact": annotated(a.Options(threshold=1.0, verbose=True)),
    "ann_with_patterns": annotated(None, True),
    "ann_patterns": lambda s, d: a.pattern_denotations(docs(s, d), patterns(s)),
    "ann_spans": spans,
    "ann_surface": surface,
    "ann_context_filter": kept,
}
QUERIES["join_pattern_text"] = lambda s, d: QUERIES["ann_patterns"](s, d).groupBy("doc_id", "obj").agg(F.count(F.lit(1)).alias("n"))
ORACLE["join_pattern_text"] = """WITH p AS (SELECT doc_id, unnest(['GENE', 'TEMPERATURE', 'DOSE']) AS obj, unnest([len(regexp_extract_all(text, '[A-Z]{2,5}[0-9]+')),
    len(regexp_extract_all(text, '[0-9]+ °C')), len(regexp_extract_all(text, '[0-9.]+ ?(mg|µg)/[a-zA-Z]+'))]) AS n FROM documents) SELECT doc_id, obj, n FROM p WHERE n > 0"""
