"""The most similar vectors of every vector, by multi-probe p-stable hashing and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforge.session import written


SKETCH = ["signs", "sizes"]
SHIFTS = (0, 6, 12, 18)
BLOCK_BITS, BITS_EACH = 1 << 15, 20
ASKED_BLOCK, ROW_BLOCK = 20_000, 60_000
#: Two-bit sketch of a coordinate of unit variance: its sign, and whether it lies beyond LARGE; it then counts as RATIO times a small one.
LARGE, RATIO = 0.9816, 3.335


@dataclass(frozen=True)
class Hashing:
    """Parameters of the index: `tables` tables of `functions` p-stable functions floor((a.x + b) / width), `probes` further buckets a table.

    With every row goes a sketch of two bits for each of 64 rotated coordinates, and candidates whose sketches are less than sketch_least
    similar are not reranked. Vectors of cosine 0.82 have 0.742 on average with a deviation of 0.037; all but one in 60,000 of them pass, as do
    0.8 % of those of cosine 0.5. -1 turns the sketches off.

    Occupied buckets are looked up in bitmaps of round_bits at most, which is 32 MiB, with BITS_EACH bits for each bucket whatever their
    number: where there are more buckets, they are taken in several rounds (see rounds()). Buckets of more than `crowded` vectors are searched in blocks of `block` vectors.
    """

    dim: int = 64
    tables: int = 12
    functions: int = 28
    width: float = 2.2
    probes: int = 150
    seed: int = 7
    sketch_least: float = 0.566
    round_bits: int = 1 << 28
    crowded: int = 200
    block: int = 8000


@dataclass(frozen=True)
class Round:
    """Buckets that are looked up together: those of some tables, or, of one table, those of one of `parts` parts by bucket."""

    tables: tuple[int, ...]
    part: int
    parts: int

    def holds(self, bucket: np.ndarray) -> np.ndarray | slice:
        return slice(None) if self.parts == 1 else bucket % self.parts == self.part


def rounds(h: Hashing, n: int) -> list[Round]:
    """As few rounds as keep BITS_EACH bits a bucket for n vectors.

    Up to round_bits / BITS_EACH vectors (13 million) each table is looked into once, so the work a vector doesn't depend on n; beyond,
    a table's probes are made anew in each of its parts.
    """
    most = max(1, h.round_bits // BITS_EACH)
    if n <= most:
        each = max(1, min(h.tables, most // max(1, n)))
        return [Round(tuple(range(at, min(at + each, h.tables))), 0, 1) for at in range(0, h.tables, each)]
    parts = -(-n // most) | 1  # odd, so that parts cut across the bits from which places in the bitmap are taken
    return [Round((t,), p, parts) for t in range(h.tables) for p in range(parts)]


def probe_order(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks to perturb, best first by the expected squared distance to the bucket.

    The distances of a vector to both borders of its bucket in every function are ranked; expected squares of the ranked distances depend on
    `functions` only, so one order of sets serves all vectors, and each vector maps ranks to its own nearest borders. Ranks j and
    2 * functions - 1 - j are the two borders of one function, which no set crosses both.
    """
    m = functions
    z = [(j * (j + 1) / (4 * (m + 1) * (m + 2))) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    found: list[tuple[int, ...]] = []
    heap = [(z[0], (0,))]
    while heap and len(found) < probes:
        _, s = heapq.heappop(heap)
        if all(2 * m - 1 - j not in s for j in s):
            found.append(s)
        if s[-1] + 1 < 2 * m:
            for t in (s[:-1] + (s[-1] + 1,), s + (s[-1] + 1,)):
                heapq.heappush(heap, (sum(z[j] for j in t), t))
    return found


class Planes:
    """The random numbers of an index; the same on every worker, as they follow from the seed."""

    def __init__(self, h: Hashing) -> None:
        rng = np.random.default_rng(h.seed)
        self.h = h
        self.a = rng.normal(size=(h.dim, h.tables * h.functions)).astype(np.float32) / np.float32(h.width)
        self.b = rng.uniform(0, 1, h.tables * h.functions).astype(np.float32)
        self.mult = rng.integers(1, 2**62, (h.tables, h.functions), dtype=np.int64) * 2 + 1
        self.base = rng.integers(1, 2**62, h.tables, dtype=np.int64)
        turned = np.random.default_rng(h.seed + 1).normal(size=(h.dim, 64))
        self.turned = ((np.linalg.qr(turned)[0] * np.sqrt(h.dim)) if h.dim >= 64 else turned).astype(np.float32)

    def cells(self, x: np.ndarray, tables: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each of the tables, and the position within it along each function."""
        t, m = list(tables), self.h.functions
        cols = (np.array(t)[:, None] * m + np.arange(m)).ravel()
        p = x @ self.a[:, cols] + self.b[cols]
        k = np.floor(p)
        shape = (len(x), len(t), m)
        return (k.astype(np.int64).reshape(shape) * self.mult[t]).sum(2) + self.base[t], (p - k).reshape(shape)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """A column of signs and one of sizes, 64 bits each."""
        z = x @ self.turned
        return np.concatenate([np.packbits(z > 0, axis=1), np.packbits(np.abs(z) > LARGE, axis=1)], 1).view(np.int64)

    def probes(self, bucket: np.ndarray, within: np.ndarray, sets: list[tuple[int, ...]], table: int) -> np.ndarray:
        """Buckets beside those of one table, a column per set."""
        m, mult = self.h.functions, self.mult[table]
        used = max(max(s) for s in sets) + 1
        near = np.argsort(np.concatenate([within, 1 - within], 1), axis=1)[:, :used]
        step = np.where(near < m, -mult[near % m], mult[near % m])
        return np.stack([bucket + step[:, list(s)].sum(1) for s in sets], 1)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def _units(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vec = b.column(0), b.column(1)
            fits = pc.fill_null(pc.equal(pc.list_value_length(vec), dim), False)
            ids, vec = ids.filter(fits), vec.filter(fits)
            flat = pc.list_flatten(vec)
            x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            unit = (x[good] / norm[good, None]).astype(np.float32)
            yield pa.record_batch({"id": ids.filter(pa.array(good)), "vec": pa.array([u.tobytes() for u in unit], pa.binary())})

    return run


def unit_vectors(df: DataFrame, id_col: str, vec: str, dim: int) -> DataFrame:
    """(id, vec) of the usable vectors at length 1, as bytes of floats: not null, dim numbers, none of them null or infinite, not all zero."""
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    return rows.mapInArrow(_units(dim), "id long, vec binary")


def _index(h: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(h)
        for b in batches:
            x = _matrix(b.column(1), h.dim)
            bucket, _ = planes.cells(x, tuple(range(h.tables)))
            s = planes.sketch(x)
            rep = np.repeat(np.asarray(b.column(0)), h.tables)
            yield pa.record_batch({"bucket": bucket.ravel(), "id": rep} | {n: np.repeat(s[:, j], h.tables) for j, n in enumerate(SKETCH)})

    return run


def _buckets(h: Hashing, r: Round):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(h)
        for b in batches:
            bucket = planes.cells(_matrix(b.column(1), h.dim), r.tables)[0].ravel()
            bucket, n = np.unique(bucket[r.holds(bucket)], return_counts=True)
            yield pa.record_batch({"bucket": bucket, "n": n.astype(np.int64)})

    return run


def _probe(h: Hashing, r: Round, occupied):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, sets = Planes(h), probe_order(h.functions, h.probes)
        some, several = (np.frombuffer(x, np.uint8) for x in occupied.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                x, ids = _matrix(b.column(1), h.dim), np.asarray(b.column(0))
                bucket, within = planes.cells(x, r.tables)
                s = planes.sketch(x)
                rows, keys = [], []
                for j, t in enumerate(r.tables):
                    k = planes.probes(bucket[:, j], within[:, j], sets, t)
                    asked = np.arange(k.size) if r.parts == 1 else np.flatnonzero(r.holds(k.ravel()))
                    own = np.arange(len(x)) if r.parts == 1 else np.flatnonzero(r.holds(bucket[:, j]))
                    hit, own = asked[_taken(some, k.ravel()[asked])], own[_taken(several, bucket[own, j])]
                    rows += [hit // k.shape[1], own]
                    keys += [k.ravel()[hit], bucket[own, j]]
                i = np.concatenate(rows)
                yield pa.record_batch({"bucket": np.concatenate(keys), "id": ids[i]} | {n: s[i, j] for j, n in enumerate(SKETCH)})

    return run


def _taken(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the keys of which all bits are set; each further bit is looked up for the keys that are left."""
    left, u = np.arange(key.size), key.view(np.uint64)
    base = ((u >> np.uint64(33)) * np.uint64(len(bits) * 8 // BLOCK_BITS) >> np.uint64(31)).astype(np.int64) * BLOCK_BITS
    for shift in SHIFTS:
        at = base[left] + (key[left] >> shift & (BLOCK_BITS - 1))
        left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    return left


def occupied_buckets(reps: DataFrame, h: Hashing, r: Round, n: int) -> tuple[bytes, bytes, bool]:
    """Bitmaps in which four bits are set for every occupied bucket of a round, and for every bucket of several vectors; whether any is crowded.

    A probe into a bucket that has nobody, as nearly all have, so never leaves its task, and neither does a vector alone in its own
    bucket. The four bits of a bucket lie in one block of 4 KiB. Buckets are counted within each batch, sent to the task of their
    block, 16 bytes each, and leave it as a finished piece of the map; the driver puts the pieces together.
    """
    blocks = max(1, min(h.round_bits, -(-n * len(r.tables) // r.parts) * BITS_EACH) // BLOCK_BITS + 1)
    block = F.shiftright(F.shiftrightunsigned("bucket", 33) * blocks, 31).alias("block")
    found = reps.select("id", "vec").mapInArrow(_buckets(h, r), "bucket long, n long")
    counts = found.select("bucket", "n", block).repartition("block").groupBy("block", "bucket").agg(F.sum("n").alias("n"))
    at = F.explode(F.array(*[F.shiftright("bucket", s).bitwiseAND(BLOCK_BITS - 1) for s in SHIFTS])).alias("at")
    maps = counts.select("block", "n", at).groupBy("block")
    maps = maps.agg(F.bitmap_construct_agg("at").alias("some"), F.bitmap_construct_agg(F.when(F.col("n") > 1, F.col("at"))).alias("several"), F.max("n").alias("most"))
    some, several = (np.zeros(blocks * BLOCK_BITS // 8, np.uint8) for _ in range(2))
    any_crowded = False
    for m in maps.collect():  # 64 MiB at most
        any_crowded |= m.most > h.crowded
        at = slice(m.block * BLOCK_BITS // 8, (m.block + 1) * BLOCK_BITS // 8)
        some[at], several[at] = np.frombuffer(bytes(m.some), np.uint8), np.frombuffer(bytes(m.several), np.uint8)
    return some.tobytes(), several.tobytes(), any_crowded


def _sketches_near(one: str, two: str, least: float) -> Column:
    """Whether the cosine of the sketches of two rows is `least` or more, from counts of bits."""
    (s1, m1), (s2, m2) = ([F.col(f"{t}.{c}") for c in SKETCH] for t in (one, two))
    differ, both, either = s1.bitwiseXOR(s2), m1.bitwiseAND(m2), m1.bitwiseOR(m2)
    mixed, none = m1.bitwiseXOR(m2), F.bitwise_not(either)
    agree = lambda where: F.bit_count(where) - F.bit_count(where.bitwiseAND(differ)) * 2
    dot = agree(none) + agree(mixed) * RATIO + agree(both) * RATIO**2
    square = lambda m: F.bit_count(m) * (RATIO**2 - 1) + 64
    return dot >= F.sqrt(square(m1) * square(m2)) * least


def _similarity(dim: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _matrix(b.column(2), dim).astype(np.float64), _matrix(b.column(3), dim).astype(np.float64)
            sim = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) if len(x) else np.empty(0)
            keep = pa.array(sim >= least)
            yield pa.record_batch({"a": b.column(0).filter(keep), "b": b.column(1).filter(keep), "similarity": pa.array(sim).filter(keep)})

    return run


def _block_best(dim: int, least: float, k: int):
    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
        if len(asked) and len(rows):
            x = np.frombuffer(b"".join(rows["vec"]), np.float32).reshape(-1, dim)
            y = np.frombuffer(b"".join(asked["vec"]), np.float32).reshape(-1, dim)
            ids, no = rows["id"].to_numpy(), asked["id"].to_numpy()
            for at in range(0, len(y), 512):
                s = y[at : at + 512] @ x.T
                s[no[at : at + 512, None] == ids[None, :]] = -2
                for axis in (1, 0):  # the k best rows of each that asks, and, of these, the k best of each row
                    n = min(k, s.shape[axis])
                    near = np.take(np.argpartition(-s, n - 1, axis=axis), range(n), axis=axis)
                    i, j = np.nonzero(np.take_along_axis(s, near, axis) >= least - 1e-5)
                    q, r = (i, near[i, j]) if axis else (near[i, j], j)
                    one, two = no[at + q], ids[r]
                    out.append(pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)}))
        return pd.concat(out).drop_duplicates()

    return run


def crowded_pairs(index: DataFrame, probes: DataFrame, reps: DataFrame, least: float, k: int, h: Hashing) -> DataFrame:
    """(a, b): of every crowded bucket, for each vector that looks into it the k best of its vectors, and for each of these the k best that look.

    A bucket that holds a large part of all vectors, or that a large part looks into, would give pairs by the product of both. Here both
    are cut into blocks by a hash of the id; a task compares two blocks by matrix products and returns some k pairs per vector. Every vector of
    the bucket is compared, so nothing is capped: k others of a bucket are as many as the result can use.
    """
    blocks = lambda n, c: F.ceil(F.col(n) / h.block).cast("int").alias(c)
    crowded = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > h.crowded)
    asking = probes.select("bucket", "id").distinct()
    looks = asking.join(crowded, "bucket").groupBy("bucket", "n").agg(F.count(F.lit(1)).alias("looks"))
    crowded = written(looks.select("bucket", blocks("n", "row_blocks"), blocks("looks", "asked_blocks")), "crowded")
    vec = reps.select("id", "vec")
    own = lambda c: F.col(c).alias(c)  # noqa: E731  both sides come from one table, and columns are told apart by their origin
    part = lambda n, c: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(c)
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    rows = index.select("bucket", "id").join(crowded, "bucket").join(vec, "id")
    rows = rows.select(own("bucket"), own("id"), own("vec"), part("row_blocks", "rb"), every("asked_blocks", "qb"))
    asked = asking.join(crowded, "bucket").join(vec, "id")
    asked = asked.select(own("bucket"), own("id"), own("vec"), part("asked_blocks", "qb"), every("row_blocks", "rb"))
    key = ["bucket", "qb", "rb"]
    return asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(_block_best(h.dim, least, k), "a long, b long")


def similar_pairs(reps: DataFrame, least: float, h: Hashing, k: int = 5) -> DataFrame:
    """(a, b, similarity), a < b: pairs of distinct vectors of cosine `least` or more that share a bucket or a probed bucket.

    Of pairs that only share crowded buckets, those among the k best of either vector in such a bucket.
    """
    sc = reps.sparkSession.sparkContext
    kind = "bucket long, id long, " + ", ".join(f"{n} long" for n in SKETCH)
    vectors, n = reps.select("id", "vec"), reps.count()
    index, probes, any_crowded = vectors.mapInArrow(_index(h), kind), None, False
    for r in rounds(h, n):
        *maps, crowd = occupied_buckets(reps, h, r, n)
        found = vectors.mapInArrow(_probe(h, r, sc.broadcast(tuple(maps))), kind)
        probes, any_crowded = found if probes is None else probes.unionByName(found), any_crowded or crowd
    extra = None
    if any_crowded:
        index, probes = written(index, "index"), written(probes, "probes")
        extra = crowded_pairs(index, probes, reps, least, k, h)
        crowded = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > h.crowded).select("bucket")
        probes = probes.join(crowded, "bucket", "left_anti")
        index = index.join(crowded, "bucket", "left_anti")
    met = probes.alias("p").join(index.alias("i"), "bucket").where(F.col("i.id") != F.col("p.id"))
    if h.sketch_least > -1:
        met = met.where(_sketches_near("p", "i", h.sketch_least))
    pairs = met.select(F.least("i.id", "p.id").alias("a"), F.greatest("i.id", "p.id").alias("b"))
    pairs = (pairs if extra is None else pairs.unionByName(extra)).distinct()
    one, two = reps.select(F.col("id").alias("a"), F.col("vec").alias("x")), reps.select(F.col("id").alias("b"), F.col("vec").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_similarity(h.dim, least), "a long, b long, similarity double")


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _best_of_all(dim: int, k: int, asked_tile: int = 512, row_tile: int = 4096):
    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.empty(0, np.int64), "c": np.empty(0, np.int64), "similarity": np.empty(0)})]
        if len(asked) and len(rows):
            x = np.frombuffer(b"".join(rows["vec"]), np.float32).reshape(-1, dim)
            y = np.frombuffer(b"".join(asked["vec"]), np.float32).reshape(-1, dim)
            ids, no = rows["id"].to_numpy(), asked["id"].to_numpy()
            for at in range(0, len(y), asked_tile):
                part, own = y[at : at + asked_tile], no[at : at + asked_tile]
                q, r, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                least = np.full(len(part), -2, np.float32)
                for row in range(0, len(x), row_tile):
                    s = part @ x[row : row + row_tile].T
                    if row == 0 and s.shape[1] > k:  # one more than k, as the vector itself may be there
                        least = np.partition(s, -k - 1, axis=1)[:, -k - 1] - np.float32(1e-5)
                    near = np.flatnonzero(s >= least[:, None])
                    a, b = near // s.shape[1], near % s.shape[1] + row
                    other = own[a] != ids[b]
                    a, b = a[other], b[other]
                    more = [_exact(part[a[i : i + 100_000]], x[b[i : i + 100_000]]) for i in range(0, len(a), 100_000)]
                    q, r, sim = np.concatenate([q, a]), np.concatenate([r, b]), np.concatenate([sim, *more])
                    order = np.lexsort((ids[r], -sim, q))
                    q, r, sim = q[order], r[order], sim[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    q, r, sim, rank = (v[rank < k] for v in (q, r, sim, rank))
                    full = rank == k - 1
                    least[q[full]] = sim[full] - 1e-5
                out.append(pd.DataFrame({"q": own[q], "c": ids[r], "similarity": sim}))
        return pd.concat(out)

    return run


def nearest_of_all(reps: DataFrame, k: int, h: Hashing, asked_block: int | None = None, row_block: int | None = None) -> DataFrame:
    """(q, c, similarity): the k most similar others of every one of the distinct vectors, exactly, however far they are.

    Vectors are cut twice into blocks by a hash of the id, once as those that ask and once as those that are found; a task compares two
    blocks by matrix products. Single precision only says which pairs may be among the k best; these are compared in double
    precision, so a block gives k rows per vector whatever lies close together. Vectors are at length 1 in single precision, so places whose
    similarities differ by some 1e-8 may change. The work grows as the square of the number of vectors.
    """
    n, cores = reps.count(), reps.sparkSession.sparkContext.defaultParallelism
    qs = max(1, -(-n // (asked_block or ASKED_BLOCK)))
    rs = max(-(-n // (row_block or ROW_BLOCK)), -(-cores // qs))
    own = lambda c: F.col(c).alias(c)  # noqa: E731  both sides come from one table, and columns are told apart by their origin
    part = lambda n, c: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(c)
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    asked = reps.select(own("id"), own("vec"), part(qs, "qb"), every(rs, "rb"))
    rows = reps.select(own("id"), own("vec"), part(rs, "rb"), every(qs, "qb"))
    parts = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(_best_of_all(h.dim, k), "q long, c long, similarity double")
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "c")
    return parts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def neighbours(df: DataFrame, id_col: str, vec: str, k: int = 5, least: float | None = 0.82, hashing: Hashing | None = None) -> DataFrame:
    """(id, neighbour, similarity): for every usable vector, the k most similar others among those of cosine `least` or more.

    Without `least` (None) these are the k most similar others of all, found exactly by nearest_of_all(); what follows on hashing is of the bounded search.

    Equal vectors (at length 1) are hashed once, by their smallest id, and put back afterwards, so a group of copies is never paired up:
    in a group of more than k each member's neighbours are the k smallest ids of the others. Buckets in which very many vectors lie that
    are alike but not equal are searched in blocks (see crowded_pairs). Ties in similarity go to the smaller id.
    Unusable vectors (null, another number of elements, null or infinite elements, all zero) are neither asked for nor found. An id is
    taken to be unique. The search is approximate: a pair is found if a probed bucket joins it; recall against brute force is tested.
    Similarities are exact.
    """
    h = hashing or Hashing()
    vectors = unit_vectors(df, id_col, vec, h.dim)
    hashes = written(vectors.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2")), "hashes")
    classes = hashes.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    several = written(classes.where("n > 1"), "copies")
    members = hashes.join(several, ["h1", "h2"]).select("id", "rep", "n")
    reps = written(vectors.join(members.where("id <> rep").select("id"), "id", "left_anti").select("id", "vec"), "representatives")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = written(first.groupBy("rep", "n").agg(F.array_sort(F.collect_list("id")).alias("heads")), "heads")

    inside = members.join(heads.select("rep", "heads"), "rep").select(
        "id", F.explode(F.slice(F.array_remove("heads", F.col("id")), 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity")
    )
    if least is None:
        ways = written(nearest_of_all(reps, k, h), "nearest")
    else:
        pairs = written(similar_pairs(reps, least, h, k), "pairs")
        ways = pairs.select(F.col("a").alias("q"), F.col("b").alias("c"), "similarity").unionByName(pairs.select(F.col("b").alias("q"), F.col("a").alias("c"), "similarity"))
    found = heads.select(F.col("rep").alias("c"), F.slice("heads", 1, k).alias("ids"))
    asked = heads.select(F.col("rep").alias("q"), F.col("n"), F.col("heads").alias("askers"))
    ways = ways.join(found, "c", "left").join(asked, "q", "left").where(F.coalesce("n", F.lit(1)) <= k)
    ways = ways.withColumn("neighbour", F.explode(F.coalesce("ids", F.array("c"))))
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "neighbour")
    best = ways.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    best = best.where(F.col("r") <= k - F.coalesce("n", F.lit(1)) + 1)
    outside = best.select(F.explode(F.coalesce("askers", F.array("q"))).alias("id"), "neighbour", "similarity")
    return inside.unionByName(outside)
