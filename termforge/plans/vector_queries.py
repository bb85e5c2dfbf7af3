"""Vector functions, searches and analytics over the vectors of dictionary 16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions.udfs import hash_embedder
from termforge.functions.vectors import cosine_distance, usable
from termforge.operators import analysis as an
from termforge.operators import dictionary_jobs, edits
from termforge.operators.knn import exact_knn
from termforge.operators.lookup import semantic_single
from termforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DIM, BELOW, LEAST = 64, 0.75, 3
TAGS = ["pediatric", "Chemistry", "medicine"]
TAGS_SQL = "('pediatric', 'Chemistry', 'medicine')"
_USABLE = "len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0"
_V = f"v AS (SELECT id, label, identifier, embedding::DOUBLE[] AS e FROM semantic_dict_16 WHERE searchable AND {_USABLE})"
_ORIGIN = f"o AS (SELECT id, label, embedding::DOUBLE[] AS q, row_number() OVER (ORDER BY id) AS n FROM semantic_dict_16 WHERE {_USABLE} ORDER BY id LIMIT 2)"
_CENTROID = "list_transform(range(1, 65), lambda i: list_avg(list_transform(list(e), lambda x: x[i])))"
_OWN = f"""s AS (SELECT identifier, count(*) AS n, {_CENTROID} AS c FROM v WHERE identifier IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST}),
    d AS (SELECT id, identifier, n, list_cosine_distance(e, c) AS distance FROM v JOIN s USING (identifier))"""


def add(name, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def semantic(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "semantic_dict_16")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return an.searchable_vectors(semantic(s, d), DIM)


def origins(s: SparkSession, d: str) -> DataFrame:
    """Stand-ins for the vectors of two general terms: those of the two lowest ids."""
    two = semantic(s, d).where(usable(F.col("embedding"), DIM)).orderBy("id").limit(2)
    return two.select(F.col("id").alias("no"), F.coalesce("label", F.lit("?")).alias("term"), F.col("embedding").alias("vec"))


def asked(s: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """The query set: every vector whose id is divisible by 20."""
    return (rows if rows is not None else semantic(s, d).where(usable(F.col("embedding"), DIM))).where("id % 20 = 0")


def knn(k: int, most: float | None, tagged: bool = False):
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = vectors(s, d)
        if tagged:
            from termforge.operators.filters import with_any_tag

            rows = with_any_tag(rows, table(s, d, "entry_tags"), table(s, d, "tags"), TAGS)
        none = F.lit(None).cast("string")
        q = asked(s, d).select((-F.col("id")).alias("no"), none.alias("grp"), F.col("embedding").alias("vec"))
        found = exact_knn(q, rows.select("id", none.alias("grp"), F.col("embedding").alias("vec")), k, most)
        return found.select((-F.col("query")).alias("query"), "id", F.round("distance", 6).alias("distance"))

    return run


_ASKED = f"a AS (SELECT id AS query, identifier AS own, embedding::DOUBLE[] AS q FROM semantic_dict_16 WHERE id % 20 = 0 AND {_USABLE})"


def _knn_sql(k: int, before: str = "true", after: str = "true") -> str:
    return f"""WITH {_V}, {_ASKED}, p AS (SELECT query, id, list_cosine_distance(q, e) AS distance FROM a, v WHERE {before}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), id) AS r FROM p)
    SELECT query, id, round(distance, 6) AS distance FROM r WHERE r <= {k} AND {after}"""


add("fn_cosine_distance", lambda s, d: _distances(s, d), f"WITH {_V}, {_ORIGIN} SELECT v.id, o.id AS origin, round(list_cosine_distance(e, q), 6) AS distance FROM v, o")


def _distances(s: SparkSession, d: str) -> DataFrame:
    o = F.broadcast(origins(s, d).select(F.col("no").alias("origin"), "vec"))  # two rows
    return vectors(s, d).join(o, F.lit(True)).select("id", "origin", F.round(cosine_distance(F.col("embedding"), F.col("vec")), 6).alias("distance"))


add(
    "join_knn_topk10",
    lambda s, d: knn(10, None)(s, d).where("distance <= 0.3"),
    _knn_sql(10, after="round(distance, 6) <= 0.3"),
)
add("join_knn_topk5", knn(5, 0.3), _knn_sql(5, before="list_cosine_distance(q, e) <= 0.3"))
_TAGGED = f"id IN (SELECT x.entry_id FROM entry_tags x JOIN tags t ON t.id = x.tag_id WHERE t.value IN {TAGS_SQL})"
add("join_knn_topk5_tags", knn(5, 0.9, True), _knn_sql(5, before=f"list_cosine_distance(q, e) <= 0.9 AND {_TAGGED}"))


def knn_entries(most: float, tagged: bool = False):
    """Dictionaries without a semantic table: the 5 nearest entries of each dictionary to every asked vector of both tables."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "entries").where(usable(F.col("embedding"), DIM)).select("id", "dictionary_id", "embedding")
        both = rows.unionByName(semantic(s, d).where(usable(F.col("embedding"), DIM)).select("id", "dictionary_id", "embedding"))
        none = F.lit(None).cast("string")
        q = asked(s, d, both).select((-F.col("id")).alias("no"), none.alias("grp"), F.col("embedding").alias("vec"))
        rows = rows.where("dictionary_id IS NOT NULL")
        if tagged:
            from termforge.operators.filters import with_any_tag

            rows = with_any_tag(rows, table(s, d, "entry_tags"), table(s, d, "tags"), TAGS)
        found = exact_knn(q, rows.select("id", none.alias("grp"), F.col("embedding").alias("vec"), F.col("dictionary_id").alias("per")), 5, most)
        return found.select((-F.col("query")).alias("query"), F.col("per").alias("dictionary_id"), "id", F.round("distance", 6).alias("distance"))

    return run


def _knn_entries_sql(before: str) -> str:
    return f"""WITH v AS (SELECT id, dictionary_id, embedding::DOUBLE[] AS e FROM entries WHERE {_USABLE}),
    a AS (SELECT id AS query, e AS q FROM v WHERE id % 20 = 0 UNION ALL SELECT id, embedding::DOUBLE[] FROM semantic_dict_16 WHERE id % 20 = 0 AND {_USABLE}),
    p AS (SELECT query, dictionary_id, id, list_cosine_distance(q, e) AS distance FROM a, v WHERE dictionary_id IS NOT NULL AND {before}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query, dictionary_id ORDER BY round(distance, 12), id) AS r FROM p)
    SELECT query, dictionary_id, id, round(distance, 6) AS distance FROM r WHERE r <= 5"""


add("join_knn_topk5_entries", knn_entries(0.3), _knn_entries_sql("list_cosine_distance(q, e) <= 0.3"))
add("join_knn_topk5_entries_tags", knn_entries(0.5, True), _knn_entries_sql(f"list_cosine_distance(q, e) <= 0.5 AND {_TAGGED}"))
add("lim_knn", knn(3, None), _knn_sql(3))
add("op_batch_semantic", knn(10, None), _knn_sql(10))


def single(strict: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        q = [float(x) for x in origins(s, d).orderBy("no").first().vec]
        return semantic_single(semantic(s, d), q, 0.5, strict).select("id", "identifier", F.round(1 - F.col("distance"), 6).alias("score"))

    return run


_SINGLE = """WITH {0}, d AS (SELECT s.id, identifier, list_cosine_distance(embedding::DOUBLE[], q) AS distance FROM semantic_dict_16 s, o WHERE n = 1 AND {1} AND {2})
    SELECT id, identifier, round(1 - distance, 6) AS score FROM d WHERE distance <= 0.5 ORDER BY distance, id LIMIT 5"""
add("join_knn_single", single(False), _SINGLE.format(_ORIGIN, _USABLE, "true"))
add("op_search_semantic", single(True), _SINGLE.format(_ORIGIN, _USABLE, "searchable"))


def rounded(c: str):
    return F.transform(c, lambda x: F.round(x, 5))


add("agg_centroid_all", lambda s, d: an.centroid_all(vectors(s, d), DIM).select(F.posexplode(rounded("centroid")).alias("pos", "x")), f"WITH {_V}, c AS (SELECT {_CENTROID} AS c FROM v) SELECT CAST(i - 1 AS INTEGER) AS pos, round(c[i], 5) AS x FROM c, range(1, 65) t(i)")
add(
    "agg_centroid_cluster",
    lambda s, d: an.centroid_by_cluster(vectors(s, d), LEAST, DIM).select("identifier", "n", F.posexplode(rounded("centroid")).alias("pos", "x")),
    f"WITH {_V}, {_OWN} SELECT identifier, n, CAST(i - 1 AS INTEGER) AS pos, round(c[i], 5) AS x FROM s, range(1, 65) t(i)",
)
_STATS = "round(avg(distance), 4) AS avg_distance, round(max(distance), 4) AS max_distance"
_ALL = f"c AS (SELECT {_CENTROID} AS c FROM v), d AS (SELECT list_cosine_distance(e, c) AS distance FROM v, c)"
add("agg_centroid_stats", lambda s, d: an.centroid_stats(vectors(s, d), DIM), f"WITH {_V}, {_ALL} SELECT {_STATS} FROM d")
add("join_cross_centroid", lambda s, d: _to_centroid(s, d), f"WITH {_V}, c AS (SELECT {_CENTROID} AS c FROM v) SELECT id, round(list_cosine_distance(e, c), 6) AS distance FROM v, c")


def _to_centroid(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    one = F.broadcast(an.centroid_all(v, DIM))  # one row
    return v.join(one, F.lit(True)).select("id", F.round(cosine_distance(F.col("embedding"), F.col("centroid")), 6).alias("distance"))


add("agg_local_stats", lambda s, d: an.local_stats(vectors(s, d), LEAST, DIM), f"WITH {_V}, {_OWN} SELECT {_STATS} FROM d")
_NEAR = "m AS (SELECT v.id, v.label, v.identifier, min(list_cosine_distance(e, q)) AS distance, arg_min(o.label, {k: list_cosine_distance(e, q), n: n}) AS closest FROM v, o GROUP BY 1, 2, 3)"
add("agg_origin_stats", lambda s, d: an.origin_stats(vectors(s, d), origins(s, d)), f"WITH {_V}, {_ORIGIN}, {_NEAR} SELECT {_STATS} FROM m")
add("fn_least_origin", lambda s, d: an.origin_distances(vectors(s, d), origins(s, d)).select("id", F.round("distance", 6).alias("distance"), "closest"), f"WITH {_V}, {_ORIGIN}, {_NEAR} SELECT id, round(distance, 6) AS distance, closest FROM m")
add("op_origin_outliers", lambda s, d: an.origin_outliers(vectors(s, d), origins(s, d), BELOW).select("id", F.round("distance", 6).alias("distance"), "closest"), f"WITH {_V}, {_ORIGIN}, {_NEAR} SELECT id, round(distance, 6) AS distance, closest FROM m WHERE distance < {BELOW}")
add("agg_outlier_distribution", lambda s, d: an.outlier_distribution(an.origin_outliers(vectors(s, d), origins(s, d), BELOW)), f"WITH {_V}, {_ORIGIN}, {_NEAR} SELECT closest, count(*) AS n FROM m WHERE distance < {BELOW} GROUP BY 1")
add(
    "agg_cluster_mean_std",
    lambda s, d: an.cluster_distances(vectors(s, d), LEAST, DIM).groupBy("identifier").agg(F.round(F.avg("distance"), 6).alias("mean"), F.round(F.stddev("distance"), 6).alias("deviation")),
    f"WITH {_V}, {_OWN} SELECT identifier, round(avg(distance), 6) AS mean, round(stddev(distance), 6) AS deviation FROM d GROUP BY 1",
)
add("join_cluster", lambda s, d: an.cluster_distances(vectors(s, d), LEAST, DIM).select("id", "identifier", "n", F.round("distance", 6).alias("distance")), f"WITH {_V}, {_OWN} SELECT id, identifier, n, round(distance, 6) AS distance FROM d")
_Z = "z AS (SELECT id, identifier, (distance - avg(distance) OVER w) / nullif(stddev(distance) OVER w, 0) AS z FROM d WINDOW w AS (PARTITION BY identifier))"
z_rows = lambda most: lambda s, d: an.local_outliers(vectors(s, d), LEAST, most, DIM).select("id", "identifier", F.round("z_score", 5).alias("z_score"))
add("fn_z_score", z_rows(-1e9), f"WITH {_V}, {_OWN}, {_Z} SELECT id, identifier, round(z, 5) AS z_score FROM z WHERE z IS NOT NULL")
add("op_local_outliers", z_rows(1.2), f"WITH {_V}, {_OWN}, {_Z} SELECT id, identifier, round(z, 5) AS z_score FROM z WHERE z > 1.2")
_FIRST = f"WITH {_V.replace('v AS', 'w AS', 1)}, {_ORIGIN}, {_NEAR.replace('FROM v, o', 'FROM w v, o')}, g AS (SELECT id FROM m WHERE distance < {BELOW}), v AS (SELECT * FROM w WHERE id NOT IN (SELECT id FROM g)), {_OWN}, {_Z}"
add("op_clean_two_stage", lambda s, d: an.clean_two_stage(semantic(s, d), origins(s, d), DIM, BELOW, 1.2, LEAST).outliers, f"{_FIRST} SELECT id, 'global' AS stage FROM g UNION ALL SELECT id, 'local' FROM z WHERE z > 1.2")
add(
    "op_clean_two_stage_applied",
    lambda s, d: an.clean_two_stage(semantic(s, d), origins(s, d), DIM, BELOW, 1.2, LEAST, dry_run=False).semantic.select("id", "searchable"),
    f"{_FIRST} SELECT id, searchable AND id NOT IN (SELECT id FROM g UNION SELECT id FROM z WHERE z > 1.2) AS searchable FROM semantic_dict_16",
)


def _state_sql(rows: str, t: str) -> str:
    """Distances to the centroid and leave-one-out metrics of the vectors in `rows`, as CTEs named with t, the last of which is x<t>."""
    return f"""c{t} AS (SELECT {_CENTROID} AS c FROM {rows}), d{t} AS (SELECT list_cosine_distance(e, c) AS distance FROM {rows}, c{t}), s{t} AS (SELECT {_STATS} FROM d{t}),
    n{t} AS (SELECT identifier FROM {rows} WHERE identifier IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
    a{t} AS (SELECT id AS query, identifier AS own, e AS q FROM {rows} WHERE id % 20 = 0 AND identifier IN (SELECT identifier FROM n{t})),
    r{t} AS (SELECT query, own, identifier, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_distance(q, e), 12), id) AS r FROM a{t}, {rows} WHERE id <> query),
    h{t} AS (SELECT query, min(r) FILTER (identifier = own) AS first_rank FROM r{t} WHERE r <= 5 GROUP BY 1),
    m{t} AS ({_METRICS.format(rows=rows)} FROM h{t}), x{t} AS (SELECT * FROM s{t}, m{t})"""


_METRICS = """SELECT count(*) AS total_tested, (SELECT count(*) FROM {rows}) AS total_searchable, coalesce(round(avg(CASE WHEN first_rank = 1 THEN 1 ELSE 0 END) * 100, 2), 0) AS rank1_accuracy,
    coalesce(round(avg(CASE WHEN first_rank <= 5 THEN 1 ELSE 0 END) * 100, 2), 0) AS top5_accuracy, coalesce(round(avg(coalesce(1.0 / first_rank, 0)), 4), 0) AS mrr"""
_REPORT = ["avg_distance", "max_distance", "total_tested", "total_searchable", "rank1_accuracy", "top5_accuracy", "mrr"]


def cleaned_by_origin(s: SparkSession, d: str) -> DataFrame:
    return an.clean_by_origin(semantic(s, d), origins(s, d), DIM, BELOW, dry_run=False, tested=F.col("id") % 20 == 0).report


add(
    "op_clean_origin",
    cleaned_by_origin,
    f"""WITH {_V}, {_ORIGIN}, {_NEAR}, w AS (SELECT * FROM v WHERE id NOT IN (SELECT id FROM m WHERE distance < {BELOW})), {_state_sql("v", "1")}, {_state_sql("w", "2")}
    SELECT (SELECT count(*) FROM m WHERE distance < {BELOW}) AS n_outliers, {", ".join(f"x{n}.{c} AS {c}_{t}" for n, t in ((1, "before"), (2, "after")) for c in _REPORT)} FROM x1, x2""",
)


def similar(exclude: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        v = vectors(s, d)
        return an.similar_entries(v, asked(s, d), 10, exclude).select("query", "id", "similarity", "distance")

    return run


def _similar_sql(cond: str) -> str:
    return f"""WITH {_V}, {_ASKED}, p AS (SELECT query, id, list_cosine_distance(q, e) AS distance FROM a, v WHERE id <> query AND {cond}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), id) AS r FROM p)
    SELECT query, id, round(1 - distance, 4) AS similarity, round(distance, 4) AS distance FROM r WHERE r <= 10"""


add("op_similar_entries", similar(False), _similar_sql("true"))
add("op_similar_entries_other_identifier", similar(True), _similar_sql("(identifier IS NULL OR own IS NULL OR identifier <> own)"))
loo = lambda i: lambda s, d: an.leave_one_out(vectors(s, d), asked(s, d, vectors(s, d)))[i]
_LOO = f"""WITH {_V}, n AS (SELECT identifier FROM v WHERE identifier IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
    a AS (SELECT id AS query, identifier AS own, e AS q FROM v WHERE id % 20 = 0 AND identifier IN (SELECT identifier FROM n)),
    r AS (SELECT query, own, identifier, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_distance(q, e), 12), id) AS r FROM a, v WHERE id <> query),
    h AS (SELECT query, min(r) FILTER (identifier = own) AS first_rank FROM r WHERE r <= 5 GROUP BY 1)"""
add("join_self_knn_loo", loo(0), f"{_LOO} SELECT query, CAST(first_rank AS INTEGER) AS first_rank FROM h")
add("agg_loo_metrics", loo(1), f"{_LOO} {_METRICS.format(rows='v')} FROM h")
add("op_loo_validation", loo(1), f"{_LOO} {_METRICS.format(rows='v')} FROM h")
add(
    "smp_random",
    lambda s, d: an.sample(semantic(s, d), 100).join(semantic(s, d).select("id"), "id").groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids")),
    "SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_ids FROM semantic_dict_16",
)
add("lim_sample", lambda s, d: an.origin_outliers(vectors(s, d), origins(s, d), BELOW, 10).select("id", F.round("distance", 6).alias("distance")), f"WITH {_V}, {_ORIGIN}, {_NEAR} SELECT id, round(distance, 6) AS distance FROM m WHERE distance < {BELOW} ORDER BY distance, id LIMIT 10")


def contexts(s: SparkSession, d: str) -> DataFrame:
    """Similarity of every pair of context and asked vector."""
    c = table(s, d, "dictionaries").where(usable(F.col("context_embedding"), DIM)).select(F.col("id").alias("dictionary_id"), "context_embedding")
    q = asked(s, d).select(F.col("id").alias("query"), "embedding")
    pairs = q.join(F.broadcast(c), F.lit(True))  # the dictionaries of a request, 240 at most
    return pairs.select("query", "dictionary_id", F.round(1 - cosine_distance(F.col("embedding"), F.col("context_embedding")), 6).alias("similarity"))


add(
    "fn_context_similarity",
    contexts,
    f"""WITH {_ASKED}, c AS (SELECT id AS dictionary_id, context_embedding::DOUBLE[] AS c FROM dictionaries WHERE {_USABLE.replace('embedding', 'context_embedding')})
    SELECT query, dictionary_id, round(1 - list_cosine_distance(q, c), 6) AS similarity FROM a, c""",
)


LETTERS = "aeinorst"


def counted(c: str):
    """An embedder that SQL can follow: how often each of eight letters occurs."""
    low = F.lower(c)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x)))).cast("double") for x in LETTERS])


def _counted_sql(c: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower({c})) - length(replace(lower({c}), '{x}', '')) AS DOUBLE)" for x in LETTERS) + "]"


def embedding_job(s: SparkSession, d: str, **more) -> dictionary_jobs.Embedded:
    return dictionary_jobs.update_embeddings(table(s, d, "entries"), semantic(s, d), 16, counted, len(LETTERS), **more)


def embedded(s: SparkSession, d: str) -> DataFrame:
    """The semantic table of dictionary 16 after all its labels were embedded anew: new vectors, kept ones, and flags."""
    v = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ")
    return embedding_job(s, d).semantic.select("id", "label", "searchable", F.when(F.size("embedding") == len(LETTERS), v).otherwise("kept").alias("vec"))


def embedding_report(s: SparkSession, d: str) -> DataFrame:
    near = s.createDataFrame([(0, "DNA"), (1, "protein")], "no int, term string").withColumn("vec", counted("term"))
    return embedding_job(s, d, origins=near, below=0.3).report


_MADE = f"""h AS (SELECT id, label, identifier, coalesce(mode <> 2, true) AS searchable, {_counted_sql("coalesce(label, '')")} AS v FROM entries WHERE dictionary_id = 16),
    g AS (SELECT * FROM h WHERE label IS NOT NULL AND list_sum(v) > 0)"""
add(
    "op_update_embeddings",
    embedded,
    f"""WITH {_MADE}, k AS (SELECT id, label, searchable, 'kept' AS vec FROM semantic_dict_16 WHERE id NOT IN (SELECT id FROM g)
    UNION ALL SELECT id, label, searchable, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ' ') FROM g)
    SELECT k.id, k.label, coalesce(h.searchable, k.searchable) AS searchable, vec FROM k LEFT JOIN h USING (id)""",
)
add(
    "op_update_embeddings_report",
    embedding_report,
    f"""WITH {_MADE}, o AS (SELECT {_counted_sql("'DNA'")} AS a, {_counted_sql("'protein'")} AS b),
    n AS (SELECT count(*) AS n FROM g, o WHERE searchable AND least(list_cosine_distance(v, a), list_cosine_distance(v, b)) < 0.3)
    SELECT count(*) AS total, (SELECT count(*) FROM g) AS completed, count(*) - (SELECT count(*) FROM g) AS failed, round((SELECT count(*) FROM g) / count(*) * 100, 2) AS success_rate,
    (SELECT n FROM n) AS n_outliers FROM h""",
)
add("src_embedding_server", lambda s, d: table(s, d, "dictionaries").where("description IS NOT NULL").select("id", hash_embedder(16)("description").alias("embedding")))


def contexts_updated(s: SparkSession, d: str) -> DataFrame:
    """Every third description changed, some to nothing."""
    before = table(s, d, "dictionaries")
    new = F.when(F.col("id") % 9 == 0, F.lit(" ")).when(F.col("id") % 3 == 0, F.concat(F.coalesce("description", F.lit("some")), F.lit(" more"))).otherwise(F.col("description"))
    out = dictionary_jobs.update_context(before, before.withColumn("description", new), counted)
    v = F.array_join(F.transform("context_embedding", lambda x: x.cast("int").cast("string")), " ")
    return out.select("id", F.when(F.size("context_embedding") == len(LETTERS), v).when(F.col("context_embedding").isNotNull(), "kept").alias("vec"))


add(
    "op_update_context",
    contexts_updated,
    f"""WITH n AS (SELECT *, CASE WHEN id % 9 = 0 THEN ' ' WHEN id % 3 = 0 THEN coalesce(description, 'some') || ' more' ELSE description END AS d FROM dictionaries)
    SELECT id, CASE WHEN d IS NOT DISTINCT FROM description THEN CASE WHEN context_embedding IS NOT NULL THEN 'kept' END
    WHEN trim(d) <> '' THEN array_to_string(list_transform({_counted_sql("d")}, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ' ') END AS vec FROM n""",
)
