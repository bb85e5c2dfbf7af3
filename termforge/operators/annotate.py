"""Annotating texts with the terms of dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions import text as kernels
from termforge.functions.abbreviations import local_abbreviations
from termforge.functions.patterns import matches
from termforge.functions.patterns import usable as usable_pattern
from termforge.functions.resolve import Denotation, merged, resolve
from termforge.functions.similarity import scored, str_sim
from termforge.functions.udfs import norms, worth_embedding
from termforge.functions.vectors import usable
from termforge.operators.bitmap import may_hold, string_bitmap
from termforge.operators.filters import with_any_tag, without_black
from termforge.operators.knn import held_knn
from termforge.operators.ngram import similarity_join
from termforge.session import spread, written

DENOTATION = "begin int, end int, obj string, score double, abbr_type string, string string, label string, norm1 string, norm2 string"
OCCURRENCE = "doc_id long, begin int, end int, span string, norm1 string, norm2 string"
RESULT = f"doc_id long, denotations array<struct<{', '.join(x.replace(' ', ':', 1) for x in DENOTATION.split(', '))}>>"


@dataclass(frozen=True)
class Options:
    tokens_len_min: int | None = None
    tokens_len_max: int | None = None
    threshold: float | None = None
    semantic_threshold: float | None = None
    use_ngram_similarity: bool = False
    abbreviation: bool = True
    longest: bool = True
    superfluous: bool = False
    verbose: bool = False


def compiled_entries(entries: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Entries of the dictionaries that may be found, with norms from this normaliser, and their dictionary's threshold and language."""
    d = dictionaries.select(F.col("id").alias("dictionary_id"), F.col("threshold").alias("own_threshold"), "language")
    e = without_black(entries).where("label IS NOT NULL AND identifier IS NOT NULL").select("dictionary_id", "label", "identifier")
    e = e.join(d, "dictionary_id").dropDuplicates(["dictionary_id", "label", "identifier"])
    # a fixed number of partitions: finding the words of labels costs far more than their size tells
    labels = e.select("label").distinct().repartition(entries.sparkSession.sparkContext.defaultParallelism, "label")
    return e.join(labels.select("label", norms("label").alias("n")).select("label", "n.*"), "label")


def span_rules(dictionaries: DataFrame, options: Options) -> kernels.SpanRules:
    """Length bounds and stop words over all dictionaries; a null list stands for the default words, an empty one for none."""
    from termforge.functions.stopwords import EDGE_WORDS, NO_TERM_WORDS

    rows = dictionaries.agg(
        F.min("tokens_len_min").alias("lo"),
        F.max("tokens_len_max").alias("hi"),
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("no_term_words", "no_begin_words", "no_end_words")],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("no_term_words", "no_begin_words", "no_end_words")],
    ).first()
    words = {
        c: frozenset(w for w in (rows[c] or []) if w) | frozenset(default if rows[f"null_{c}"] else [])
        for c, default in (("no_term_words", NO_TERM_WORDS), ("no_begin_words", EDGE_WORDS), ("no_end_words", EDGE_WORDS))
    }
    return kernels.SpanRules(
        options.tokens_len_min or rows.lo or 1, options.tokens_len_max or rows.hi or 6, words["no_term_words"], words["no_begin_words"], words["no_end_words"]
    )


def _parsed(text: str) -> tuple[list[kernels.Token], list[int]]:
    toks, breaks = kernels.tokens(text), kernels.sentence_breaks(text)
    kernels.add_levels(toks, text, breaks)
    return toks, breaks


def _spans(rules: kernels.SpanRules, bitmap, by_label: bool = False):
    by_norm = bitmap is not None and not by_label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool] = {}

        def wanted(key: str) -> bool:
            known = seen.get(key)
            if known is None:
                if len(seen) > 500_000:
                    seen.clear()
                known = seen[key] = may_hold(bitmap.value, key)
            return known

        for b in batches:
            rows: list[tuple] = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                toks, breaks = _parsed(t)
                for s in kernels.candidate_spans(toks, breaks, rules, wanted if by_norm else None):
                    span = t[s.begin : s.end]
                    if not by_label or wanted(span):
                        rows.append((doc, s.begin, s.end, span, s.norm1, s.norm2))
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "begin", "end", "span", "norm1", "norm2"])


def candidate_occurrences(docs: DataFrame, rules: kernels.SpanRules, known: DataFrame | None = None, by_label: bool = False) -> DataFrame:
    """(doc_id, begin, end, span, norm1, norm2) of the spans that may be terms.

    docs: (doc_id, text). known: a table with norm2 and label; spans whose norm2, or with by_label whose text, it can't hold never leave
    their task, by a bitmap of fixed size.
    """
    bitmap = None if known is None else docs.sparkSession.sparkContext.broadcast(string_bitmap(known, "label" if by_label else "norm2"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(docs, "doc_id").mapInArrow(_spans(rules, bitmap, by_label), OCCURRENCE)


def candidate_texts(docs: DataFrame, rules: kernels.SpanRules, known: DataFrame | None = None) -> DataFrame:
    """(span, held): the distinct texts of candidate_occurrences(), and whether a table with norm2 may hold a span's norm2, by a bitmap of fixed size.

    They are in a stated number of partitions, several for each core, as embedding and searching them costs far more than their size tells.
    """
    bitmap = None if known is None else docs.sparkSession.sparkContext.broadcast(string_bitmap(known, "norm2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, str] = {}
            for t in b.column(0).to_pylist():
                toks, breaks = _parsed(t)
                for s in kernels.candidate_spans(toks, breaks, rules):
                    found[t[s.begin : s.end]] = s.norm2
                if len(found) > 50_000:
                    yield told(found)
                    found = {}
            if found:
                yield told(found)

    def told(found: dict[str, str]) -> pa.RecordBatch:
        of = {} if bitmap is None else {n: may_hold(bitmap.value, n) for n in set(found.values())}
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([of.get(n, False) for n in found.values()], pa.bool_())], ["span", "held"])

    texts = spread(docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("text")
    session = docs.sparkSession
    parts = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    spans = texts.mapInArrow(run, "span string, held boolean").repartition(parts, "span")
    return spans.groupBy("span").agg(F.max("held").alias("held"))


def with_norms(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(span, norm1, norm2) of those span texts whose norm2 a table with norm2 may hold, by a bitmap of fixed size. A span's norms follow from its text."""
    bitmap = texts.sparkSession.sparkContext.broadcast(string_bitmap(known, "norm2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, *n) for s in b.column(0).to_pylist() if may_hold(bitmap.value, (n := kernels.norms(s))[1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["span", "norm1", "norm2"])

    return texts.select("span").mapInArrow(run, "span string, norm1 string, norm2 string")


def surface_matches(spans: DataFrame, known: DataFrame, options: Options) -> DataFrame:
    """(span, norm1, norm2, dictionary_id, identifier, label, score) of distinct spans.

    spans: distinct (span, norm1, norm2). A threshold of 1 and more compares labels exactly.
    """
    e = known.select("dictionary_id", "identifier", "label", F.col("norm1").alias("e1"), F.col("norm2").alias("e2"), "own_threshold", "language")
    limit = F.lit(options.threshold) if options.threshold is not None else F.col("own_threshold")
    out = ["span", "norm1", "norm2", "dictionary_id", "identifier", "label", "e1", "e2", "score"]
    exact = spans.join(e, spans["span"] == e["label"]).where(limit >= 1).withColumn("score", F.lit(1.0)).select(*out)
    if options.threshold is not None and options.threshold >= 1:
        return exact
    if options.use_ngram_similarity:
        least = options.threshold or 0.85
        if options.threshold is None:  # each dictionary's own threshold decides afterwards
            least = float(known.agg(F.coalesce(F.min("own_threshold"), F.lit(0.85))).first()[0])
        near = similarity_join(spans, "norm2", e, "e2", least).select(F.col("left").alias("norm2"), F.col("right").alias("e2"))
        m = spans.join(near, "norm2").join(e, "e2")
    else:
        m = spans.join(e, spans["norm2"] == e["e2"])
    score = str_sim(F.col("language"), F.col("span"), F.col("label"), F.col("norm1"), F.col("e1"), F.col("norm2"), F.col("e2"))
    soft = scored(m.where(limit < 1), score).where(F.col("score") >= limit).select(*out)
    return soft if options.threshold is not None else soft.unionByName(exact)


def vectors_of(semantic: DataFrame, entries: DataFrame) -> DataFrame:
    """Vectors of both tables in the columns of semantic_matches(): the semantic table, and entries of the dictionaries that have none.

    No id has a vector in both. Entries are found by their vectors whether searchable or not, and 5 a dictionary instead of 10.
    """
    cols = ["id", "dictionary_id", "label", "identifier", "searchable", "embedding"]
    own = semantic.select("dictionary_id").distinct()
    rest = entries.where("embedding IS NOT NULL AND dictionary_id IS NOT NULL").join(own, "dictionary_id", "left_anti")
    return semantic.select(*cols, F.lit(10).alias("k")).unionByName(rest.withColumn("searchable", F.lit(True)).select(*cols, F.lit(5).alias("k")))


def semantic_matches(spans: DataFrame, vectors: DataFrame, embed: Callable, threshold: float, k: int = 10, best: bool = False) -> DataFrame:
    """Matches in the columns of surface_matches(): of each span's k nearest searchable vectors of each dictionary those of similarity `threshold` or more.

    vectors: (id, dictionary_id, label, identifier, searchable, embedding), and maybe k, where it is less for some dictionaries. Spans of fewer than three characters, or of digits and signs only,
    aren't embedded. best: only what best_matches() leaves of surface_and_semantic() for spans without surface matches, found without a shuffle. embed is a column function such as an embedder of termforge.sources.embedder.
    """
    asked = spans.where(worth_embedding(F.col("span"))).select("span", "norm1", "norm2", embed("span").alias("vec"))
    per, fewer = F.coalesce("dictionary_id", F.lit(-1)).cast("long"), F.least("k", F.lit(k)) if "k" in vectors.columns else F.lit(k)
    rows = vectors.where(F.col("searchable") & usable(F.col("embedding")))
    rows = rows.select("id", "dictionary_id", "label", "identifier", F.col("embedding").alias("vec"), per.alias("per"), fewer.alias("k"))
    near = held_knn(asked, rows, 1 - threshold, first_of=("identifier", ["dictionary_id", "label"]) if best else None).where("identifier IS NOT NULL")
    none = F.lit(None).cast("string")
    return near.select("span", "norm1", "norm2", "dictionary_id", "identifier", "label", none.alias("e1"), none.alias("e2"), (1 - F.col("distance")).alias("score"))


def surface_and_semantic(found: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both kinds of matches; of a span that has semantic ones, one per identifier, surface before semantic and better before worse."""
    span = ["span", "norm1", "norm2"]
    both = found.withColumn("o", F.lit(0)).unionByName(semantic.withColumn("o", F.lit(1)))
    both = both.repartition(*span)  # serves both windows, and that of best_matches()
    order = Window.partitionBy(*span, "identifier").orderBy("o", F.desc("score"), "dictionary_id", "label")
    both = both.withColumn("r", F.row_number().over(order)).withColumn("most", F.max("o").over(Window.partitionBy(*span)))
    return both.where("r = 1 OR most = 0").drop("o", "r", "most")


def held_apart(texts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of texts whose span found may have, and those whose span it surely hasn't, by a bitmap of fixed size."""
    bitmap = texts.sparkSession.sparkContext.broadcast(string_bitmap(found, "span"))

    @F.pandas_udf("boolean")
    def held(s: pd.Series) -> pd.Series:
        return s.map(lambda x: may_hold(bitmap.value, x))

    return texts.where(held("span")), texts.where(~held("span"))


def best_matches(matches_: DataFrame, superfluous: bool) -> DataFrame:
    """Per span all matches, or those that tie for the best score."""
    if superfluous:
        return matches_
    best = F.max("score").over(Window.partitionBy("span", "norm1", "norm2"))
    return matches_.withColumn("best", best).where(F.col("score") == F.col("best")).drop("best")


def pattern_denotations(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, begin, end, obj, string): every match of every active pattern. Patterns are few rows that a user wrote, and are collected.

    One that can't be compiled matches nothing; edits.add_patterns() refuses it when it is stored.
    """
    stored = patterns.where("active AND expression IS NOT NULL AND identifier IS NOT NULL").orderBy("id").collect()
    active = [(r.expression, r.identifier) for r in stored if usable_pattern(r.expression)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (doc, a, z, obj, t[a:z]) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for e, obj in active for a, z in matches(t, e)
            ]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "begin", "end", "obj", "string"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, begin int, end int, obj string, string string")


def context_kept(docs: DataFrame, contexts: DataFrame, least: float) -> DataFrame:
    """(doc_id, dictionary_id) pairs to annotate: dictionaries without context, and those whose context is similar enough to the text.

    docs: (doc_id, vec), contexts: (dictionary_id, context_embedding); the dictionaries of a request are few rows.
    """
    from termforge.functions.vectors import cosine_distance

    pairs = docs.join(F.broadcast(contexts), F.lit(True))
    similar = 1 - cosine_distance(F.col("vec"), F.col("context_embedding")) >= least
    return pairs.where(F.col("context_embedding").isNull() | similar).select("doc_id", "dictionary_id")


FIELDS = ["begin", "end", "obj", "score", "string", "label", "norm1", "norm2"]
OUT = pa.list_(pa.struct([(n, pa.int32()) for n in ("begin", "end")] + [("obj", pa.string()), ("score", pa.float64())] + [(n, pa.string()) for n in ("abbr_type", "string", "label", "norm1", "norm2")]))


Chooser = Callable[[list[Denotation]], list[Denotation]]


def _resolved(text: str, rows: list[dict], options: Options, choose: Chooser | None) -> list[dict]:
    keep = options.verbose
    ds = list(
        dict.fromkeys(
            Denotation(r["begin"], r["end"], r["obj"], r["score"], r["string"], *((r["label"], r["norm1"], r["norm2"]) if keep else (None, None, None))) for r in rows
        )
    )
    chosen = choose(ds) if choose else resolve(ds, options.longest, options.superfluous)
    if options.abbreviation:
        chosen = merged(chosen, local_abbreviations(text, _parsed(text)[0], ds))
    return [
        {"begin": d.begin, "end": d.end, "obj": d.obj, "score": d.score, "abbr_type": d.abbr_type, "string": d.string, "label": d.label, "norm1": d.norm1, "norm2": d.norm2}
        for d in chosen
    ]


def _resolver(options: Options, choose: Chooser | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = [_resolved(t, rows, options, choose) for t, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, OUT)], ["doc_id", "denotations"])

    return run


def annotate(
    docs: DataFrame,
    entries: DataFrame,
    dictionaries: DataFrame,
    options: Options | None = None,
    patterns: DataFrame | None = None,
    contexts: DataFrame | None = None,
    semantic: DataFrame | None = None,
    tags: tuple[list[str], DataFrame, DataFrame] | None = None,
    vectors: DataFrame | None = None,
    embed: Callable | None = None,
    choose: Chooser | None = None,
    compiled: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, denotations) of every text in which a term is found.

    docs: (doc_id, text), ids unique. One pass over the texts emits candidate spans, of which a bitmap of the dictionaries' norms keeps
    those that can match; distinct spans meet the entries in one join; matches go back to their occurrences and are resolved per text. Two
    shuffles carry candidates, none carries whole texts twice.

    contexts: (doc_id, dictionary_id) pairs from context_kept(); only those dictionaries annotate a text. semantic: further matches
    (span, norm1, norm2, dictionary_id, identifier, label, e1, e2, score), which yield to surface matches of the same identifier.
    tags: (values, entry_tags, tags) keeps entries with one of the values; off unless given. vectors and embed: with a semantic_threshold,
    spans are embedded and searched as in semantic_matches(). choose takes the place of the steps that resolve overlaps. compiled: a table
    of compiled_entries() of these entries, made before; it isn't used with tags. Null and empty texts give no row.
    """
    options = options or Options()
    if tags:
        entries = with_any_tag(entries, tags[1], tags[2], tags[0])
    known = written(compiled_entries(entries, dictionaries), "compiled") if compiled is None or tags else compiled
    rules = span_rules(dictionaries, options)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND text <> ''")
    by_vector = options.semantic_threshold is not None and options.semantic_threshold > 0 and vectors is not None and embed is not None
    exactly = options.threshold is not None and options.threshold >= 1
    prune = semantic is None and not by_vector and (exactly or not options.use_ngram_similarity)
    occurrences = written(candidate_occurrences(docs, rules, known if prune else None, exactly and prune), "occurrences")
    spans = occurrences.select("span", "norm1", "norm2").distinct()
    found = surface_matches(spans, known, options)
    if by_vector:
        more = semantic_matches(spans, vectors, embed, options.semantic_threshold)
        semantic = more if semantic is None else semantic.unionByName(more)
    if semantic is not None:
        found = surface_and_semantic(found, semantic)
    where = ["span", "norm1", "norm2"]
    if contexts is None:
        found = best_matches(found, options.superfluous)
        placed = occurrences.join(found, where)
    else:
        placed = occurrences.join(found, where).join(contexts, ["doc_id", "dictionary_id"], "left_semi")
        if not options.superfluous:
            best = F.max("score").over(Window.partitionBy("doc_id", "begin", "end"))
            placed = placed.withColumn("best", best).where(F.col("score") == F.col("best"))
    ds = placed.select("doc_id", "begin", "end", F.col("identifier").alias("obj"), "score", F.col("span").alias("string"), "label", F.col("e1").alias("norm1"), F.col("e2").alias("norm2"))
    if patterns is not None:
        none = F.lit(None).cast("string")
        more = pattern_denotations(docs, patterns).select("doc_id", "begin", "end", "obj", F.lit(1.0).alias("score"), "string", none.alias("label"), none.alias("norm1"), none.alias("norm2"))
        ds = ds.unionByName(more)
    listed = ds.groupBy("doc_id").agg(F.collect_list(F.struct(*FIELDS)).alias("found"))
    done = docs.join(listed, "doc_id").select("doc_id", "text", "found").mapInArrow(_resolver(options, choose), RESULT)
    return done.where(F.size("denotations") > 0)


def exploded(annotated: DataFrame) -> DataFrame:
    """A row per denotation."""
    return annotated.select("doc_id", F.inline("denotations"))

