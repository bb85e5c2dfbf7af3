import numpy as np
import pytest

from pyspark.sql import functions as F

from termforge.llm.neighbours import SKETCH, Hashing, Planes, Round, _sketches_near, neighbours, probe_order, rounds, similar_pairs, unit_vectors


def brute(ids, x, k=5, least=0.82):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    return {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


def clustered(n, groups, spread, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 64))
    return (centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 64))) * rng.uniform(0.5, 3, (n, 1))


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.astype(float).tolist(), "clash") for i, v in zip(ids, x)], "id long, embedding array<float>, vec string")


def test_recall_against_brute_force(spark):
    x = np.concatenate([clustered(900, 300, 0.35), np.random.default_rng(4).normal(size=(300, 64))])
    ids = np.arange(1, len(x) + 1) * 3
    got = {(r.id, r.neighbour) for r in neighbours(frame(spark, ids, x), "id", "embedding").collect()}
    want = brute(ids, x)
    assert len(want) > 500 and len(got & want) / len(want) >= 0.92 and len(got & want) / len(got) >= 0.97


def test_recall_on_the_tables(spark):
    from termforge.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = [(r.id, r.embedding) for t in ("entries", "semantic_dict_16") for r in spark.read.parquet(f"{folder}/{t}.parquet").select("id", "embedding").where("size(embedding) = 64").collect()]
    rows = sorted((i, v) for i, v in rows if any(v))
    want = {(min(p), max(p)) for p in brute(np.array([i for i, _ in rows]), np.array([v for _, v in rows]))}
    got = {(r.id_a, r.id_b) for r in QUERIES["p5_found"](spark, folder).collect()}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.98


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=64), rng.normal(size=64)
    rows = [(i, a.tolist()) for i in range(1, 41)] + [(50, (a + 0.05 * b).tolist()), (51, b.tolist()), (52, b.tolist())]
    rows += [(60, None), (61, [0.0] * 64), (62, [1.0] * 63), (63, [float("nan")] * 64), (64, [None] + [1.0] * 63), (65, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {}
    for r in neighbours(df, "id", "embedding").collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == {*range(1, 41), 50, 51, 52}
    for i in range(1, 41):
        assert got[i] == set([j for j in range(1, 8) if j != i][:5])
    assert got[50] == {1, 2, 3, 4, 5} and got[51] == {52} and got[52] == {51}
    assert neighbours(df.limit(0), "id", "embedding").count() == 0


def test_crowded_buckets(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=64) + 0.02 * rng.normal(size=(900, 64)), clustered(600, 200, 0.3)])
    ids = np.arange(1, len(x) + 1)
    df = frame(spark, ids, x)
    got = {(r.id, r.neighbour) for r in neighbours(df, "id", "embedding", hashing=Hashing(crowded=50, block=200)).collect()}
    want = brute(ids, x)
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.97
    dense = {(a, b) for a, b in want if a <= 900}
    assert len(got & dense) / len(dense) >= 0.98


def test_probe_order():
    sets = probe_order(6, 40)
    assert len(set(sets)) == 40 and sets[0] == (0,) and all(11 - j not in s for s in sets for j in s)


def test_pairs_are_exact(spark):
    x = clustered(60, 6, 0.2)
    reps = unit_vectors(frame(spark, range(60), x), "id", "embedding", 64)
    got = {(r.a, r.b): r.similarity for r in similar_pairs(reps, 0.82, Hashing(tables=4)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert all(s == pytest.approx(float(u[a] @ u[b]), abs=1e-5) for (a, b), s in got.items()) and got


def test_every_vector_has_k_neighbours(spark, monkeypatch):
    from termforge.llm import neighbours as module

    monkeypatch.setattr(module, "ASKED_BLOCK", 200)
    monkeypatch.setattr(module, "ROW_BLOCK", 150)
    x = np.concatenate([clustered(300, 100, 0.35), np.random.default_rng(8).normal(size=(300, 64))])
    ids = np.arange(1, len(x) + 1) * 3
    got = [(r.id, r.neighbour) for r in neighbours(frame(spark, ids, x), "id", "embedding", least=None).collect()]
    assert len(got) == 5 * len(x) and set(got) == brute(ids, x, least=-2)


def test_whole_top_with_copies(spark):
    a, b = [1.0] + [0.0] * 63, [0.1, 1.0] + [0.0] * 62
    rows = [(i, a) for i in range(1, 9)] + [(50, b), (51, b), (52, [-1.0] + [0.0] * 63), (60, [0.0] * 64)]
    got = {}
    for r in neighbours(spark.createDataFrame(rows, "id long, embedding array<float>"), "id", "embedding", least=None).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == {*range(1, 9), 50, 51, 52}
    assert got[1] == {2, 3, 4, 5, 6} and got[8] == {1, 2, 3, 4, 5}
    assert got[50] == {51, 1, 2, 3, 4} and got[51] == {50, 1, 2, 3, 4} and got[52] == {50, 51, 1, 2, 3}


def test_whole_top_on_the_tables(spark, data):
    from termforge.llm.queries import QUERIES

    rows = [(r.id, r.embedding) for t in ("entries", "semantic_dict_16") for r in spark.read.parquet(f"{data}/{t}.parquet").select("id", "embedding").where("size(embedding) = 64").collect()]
    n = sum(any(v) for _, v in rows)
    got = QUERIES["p5_neighbours"](spark, data).groupBy("id").count().collect()
    assert len(got) == n and {r["count"] for r in got} == {5}


def pairs_of(df):
    return {(r.a, r.b) for r in df.select("a", "b").collect()}


def test_rounds_change_nothing(spark):
    reps = unit_vectors(frame(spark, range(400), clustered(400, 60, 0.3)), "id", "embedding", 64).cache()
    whole = pairs_of(similar_pairs(reps, 0.82, Hashing(tables=4, probes=40)))
    assert whole
    for bits in (1 << 15, 2400 * 20, 300 * 20):  # tables one by one, several together, and tables in parts
        assert pairs_of(similar_pairs(reps, 0.82, Hashing(tables=4, probes=40, round_bits=bits))) == whole


def test_rounds_hold_every_bucket_once():
    h = Hashing()
    assert rounds(h, 0) == [Round(tuple(range(12)), 0, 1)] and len(rounds(h, 10_000_000)) == 12
    for n in (1_000, 1_300_000, 5_000_000, 13_000_000, 40_000_000):
        rs = rounds(h, n)
        keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000)
        for t in range(h.tables):
            seen = sum(np.isin(np.arange(2000), np.arange(2000)[r.holds(keys)]).astype(int) for r in rs if t in r.tables)
            assert (seen == 1).all()
        assert max(n * len(r.tables) / r.parts for r in rs) * 20 <= h.round_bits * 1.0001


def test_equal_on_both_sides_of_crowded(spark):
    rng = np.random.default_rng(11)
    dense = [rng.normal(size=64) + 0.12 * rng.normal(size=(250, 64)) for _ in range(2)]
    df = frame(spark, range(1, 801), np.concatenate([*dense, clustered(300, 100, 0.3)]))
    best = lambda **kw: {(r.id, r.neighbour) for r in neighbours(df, "id", "embedding", hashing=Hashing(sketch_least=-1, **kw)).collect()}
    plain, crowded = best(crowded=10**6), best(crowded=3, block=60)
    assert len(plain) > 2000 and plain == crowded


def test_sketch_passes_near_ones(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    planes = Planes(Hashing())
    rows = [planes.sketch(v.astype(np.float32)) for v in (x, 0.82 * x + np.sqrt(1 - 0.82**2) * y, 0.5 * x + np.sqrt(0.75) * y)]
    names = [f"{t}{c}" for t in "xyz" for c in SKETCH]
    df = spark.createDataFrame([[int(v) for v in r] for r in np.concatenate(rows, 1)], ", ".join(f"{n} long" for n in names))
    pair = df.select(*[F.struct(*[F.col(f"{t}{c}").alias(c) for c in SKETCH]).alias(t) for t in "xyz"])
    near, far = (pair.where(_sketches_near("x", t, 0.566)).count() for t in "yz")
    assert near >= 19_997 and far < 400
