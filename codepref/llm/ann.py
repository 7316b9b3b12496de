"""Approximate nearest neighbours by an adaptive dimension scan.

Largest inner product is smallest Euclidean distance once each vector gets one
more component, sqrt(M^2 - |x|^2) with M the largest length. The extended vectors
are dealt to lists by the nearest of sampled centroids; a query probes the lists
of its nearest centroids. Within a list the vectors are rotated by a random
orthogonal matrix and held in column blocks: after each block of dimensions the
partial distance of what is left is tested against a bound on the query's best
distances (twice as deep as k within the sample), and a candidate is abandoned as
soon as its whole distance is unlikely to be smaller (ADSampling, Gao and Long,
2023). A query left with fewer than k goes through all lists without a bound. Survivors are scored exactly, in double precision, on the original vectors.

How many lists a query probes is fitted: the fewest that hold ``RECALL`` of the
true neighbours of sampled queries within the sample. Neighbours in the whole
table are nearer than those, so its recall is higher; tests measure it.

Equal vectors are searched as one: for each distinct vector the k + 1 smallest
ids are kept, which is all that any query can need, and equal queries share one
search. An id with several vectors asks on its own with each of them, and vectors
that only it holds are left out before the best are taken. Lists are cut into cells of about ``CELL`` vectors by a hash, so no list
is one task's.

Defined cases: null vectors, zero vectors, vectors with a null or non-finite
component, vectors whose length is not the most common one, and null ids take no
part; rows that repeat an id and its vector are one row; an id with different
vectors is a separate candidate and a separate query (ranks from 1) with each,
and never its own neighbour; with fewer than k candidates all are returned. Probing goes on past that many lists until
it has met 4 (k + 1) vectors or all lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepref.llm.common import hash60, materialize

#: Bounds of the fitted part: centroids, sampled vectors, sampled queries.
MAX_LISTS = 4096
LIST_SIZE = 1024
SAMPLE = 8192
SAMPLE_QUERIES = 400
RECALL = 0.96
CELL = 8192
#: Dimensions per column block; the test's false-abandon factor.
BLOCK = 16
EPSILON = 2.1
SEED = 7
SALTS = 32


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part."""
    kind = "double" if doubles(df, vector) else "float"
    x = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = x.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda v: v != 0))
    return x.withColumn("vec", F.transform("vec", lambda v: v + F.lit(0).cast(kind)))  # -0.0 is 0.0


def doubles(df: DataFrame, vector: str) -> bool:
    """Whether the vectors are in double precision; others are read as single."""
    return df.schema[vector].dataType.elementType == T.DoubleType()


def narrow(vecs, scale: float) -> np.ndarray:
    """Vectors as rows in single precision, for the search (scores are not)."""
    x = np.stack(vecs)
    return x if x.dtype == np.float32 else (x * scale).astype(np.float32)


def distinct_vectors(x: DataFrame, keep: int) -> DataFrame:
    """(rep, vec, ids): each distinct vector with its ``keep`` smallest ids, in
    two steps so that a vector held by very many rows is first cut down in parts."""
    part = x.withColumn("part", hash60(F.col("id"), ":part") % 512)
    for keys in (["vec", "part"], ["vec"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        part = part.withColumn("rank", rank).where(F.col("rank") <= keep)
    ids = F.sort_array(F.collect_list("id"))
    return part.groupBy("vec").agg(ids.alias("ids")).select(F.xxhash64("vec", "ids").alias("rep"), "vec", "ids")


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def extended(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest ** 2 - (x.astype(np.float64) ** 2).sum(axis=1), 0.0))
    return np.c_[x, rest].astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = _nearest(x, centers, 1)[:, 0]
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros(centers.shape, dtype=np.float64)
        np.add.at(sums, near, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers).astype(np.float32)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centers per row, nearest first."""
    out = np.empty((len(x), n), dtype=np.int32)
    norms = (centers ** 2).sum(axis=1)
    for a in range(0, len(x), 4096):
        d = norms - 2 * x[a:a + 4096] @ centers.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(n), (len(d), 1))
        out[a:a + 4096] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * a @ b.T, 0)


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The fewest lists to probe that hold ``recall`` of the sample's own neighbours."""
    asked = sample[np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)]
    home = _nearest(sample, centers, 1)[:, 0]
    near = _nearest(asked, centers, len(centers))
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(len(centers), dtype=near.dtype)[None, :].repeat(len(near), 0), 1)
    true = np.argsort(distances(asked, sample), axis=1, kind="stable")[:, 1:k + 1]
    needed = np.sort(np.take_along_axis(place, home[true], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


def scan(rotated: np.ndarray, queries: np.ndarray, bound: np.ndarray, epsilon: float = EPSILON,
         block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of a cell that no test abandons: ``rotated`` and
    ``queries`` are rotated alike, ``bound`` is each query's largest distance of
    interest, squared."""
    dims, n = rotated.shape[1], len(rotated)
    columns = [np.ascontiguousarray(rotated[:, a:a + block]) for a in range(0, dims, block)]
    bound = bound * (1 + 1e-4) + 1e-5  # for single precision
    found = []
    for a in range(0, len(queries), max(1, (1 << 21) // max(1, n))):
        part = queries[a:a + max(1, (1 << 21) // max(1, n))]
        limit = bound[a:a + len(part)]
        q = row = partial = None
        for i, c in enumerate(columns):
            lo, hi = i * block, i * block + c.shape[1]
            # the hypothesis that the whole distance is within the bound is given up
            # when the partial one, scaled to all dimensions, exceeds it by the margin
            margin = 1.0 if hi == dims else (hi / dims) * (1 + epsilon / np.sqrt(hi)) ** 2
            if q is None:
                whole = distances(part[:, lo:hi], c)
                q, row = np.nonzero(whole <= (limit * margin)[:, None])
                partial = whole[q, row]
            else:
                partial = partial + ((c[row] - part[q, lo:hi]) ** 2).sum(axis=1)
                stay = partial <= limit[q] * margin
                q, row, partial = q[stay], row[stay], partial[stay]
        found.append((q + a, row))
    return tuple(np.concatenate(x) for x in zip(*found))


def _cell(k: int, longest: float, turn: np.ndarray, scale: float):
    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        raw, reps = np.stack(vectors["vec"]), vectors["rep"].to_numpy()
        asked, ids = np.stack(queries["vec"]), queries["rep"].to_numpy()
        turned = np.c_[narrow(asked, scale), np.zeros(len(asked), np.float32)] @ turn
        q, row = scan(extended(narrow(raw, scale), longest) @ turn, turned, queries["bound"].to_numpy(np.float32))
        own = queries["alone"].to_numpy()[q] & vectors["single"].to_numpy()[row]
        own &= queries["own"].to_numpy()[q] == vectors["only"].to_numpy()[row]
        q, row = q[~own], row[~own]
        score = np.empty(len(q))
        for a in range(0, len(q), 1 << 15):
            at = slice(a, a + (1 << 15))
            score[at] = (raw[row[at]].astype(np.float64) * asked[q[at]].astype(np.float64)).sum(axis=1)
        order = np.lexsort((reps[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        first = np.searchsorted(q, q)  # where each query's run starts
        top = np.arange(len(q)) - first < k
        return pd.DataFrame({"q": ids[q[top]], "rep": reps[row[top]], "score": score[top]})

    return run


def search(df: DataFrame, is_query: Column, k: int = 20, probes: int | None = None, id_col: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for the rows whose id
    (column ``id``) meets ``is_query``, against every other row."""
    x = valid_vectors(df, id_col, vector)
    lengths = x.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = lengths["d"] if lengths else 1
    x = materialize(x.where(F.size("vec") == dim).distinct())
    # ids kept are cut to k + 1, so one id is all there are
    reps = materialize(distinct_vectors(x, k + 1).withColumn("single", F.size("ids") == 1).withColumn("only", F.col("ids")[0]))
    # vectors in double precision are scaled to a greatest length of 1 for the search
    top = F.array_max(F.transform("vec", lambda v: F.abs(v.cast("double")))) if doubles(df, vector) else F.lit(1.0)
    norm = F.aggregate(F.transform("vec", lambda v: v.cast("double") / top), F.lit(0.0), lambda a, v: a + v * v)
    n, longest = reps.agg(F.count(F.lit(1)), F.coalesce(F.max(F.sqrt(norm) * top), F.lit(1.0))).first()
    scale = 1.0 / longest if doubles(df, vector) else 1.0
    longest = longest * scale
    sample = reps.select("vec", "single", "only", hash60(F.col("rep"), ":sample").alias("h")).orderBy("h").limit(SAMPLE)
    taught = sample.select("vec", "single", "only").collect()  # at most SAMPLE vectors
    known = (np.array([r["vec"] for r in taught], dtype=np.float64).reshape(-1, dim) * scale).astype(np.float32)
    points = extended(known, longest)
    holders = np.array([r["single"] for r in taught], dtype=bool), np.array([r["only"] for r in taught], dtype=np.int64)
    lists = max(1, min(MAX_LISTS, n // LIST_SIZE, len(points) // 8))
    centers = kmeans(points, lists) if len(points) else np.zeros((1, dim + 1), np.float32)
    probes = probes or (probes_for(points, centers, k) if len(points) else 1)
    shared = df.sparkSession.sparkContext.broadcast(centers)
    held = df.sparkSession.sparkContext.broadcast((points, *holders))

    @F.pandas_udf("int")
    def home(vecs: pd.Series) -> pd.Series:
        return pd.Series(_nearest(extended(narrow(vecs, scale), longest), shared.value, 1)[:, 0] if len(vecs) else [], dtype="int32")

    dealt = materialize(reps.withColumn("list", home("vec")))
    counts = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}  # one row per list
    sizes = np.array([counts.get(i, 0) for i in range(len(centers))])
    cells = np.maximum(1, -(-sizes // CELL))
    spread = df.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(cells)], "list int, cells int")
    size_of = df.sparkSession.sparkContext.broadcast(sizes)

    @F.pandas_udf("array<int>")
    def probed(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        near = _nearest(np.c_[narrow(vecs, scale), np.zeros(len(vecs), np.float32)], shared.value, len(shared.value))
        met = np.cumsum(size_of.value[near], axis=1)
        enough = np.maximum(probes, (met < 4 * (k + 1)).sum(axis=1) + 1)
        return pd.Series([row[:m] for row, m in zip(near, enough)])

    @F.pandas_udf("float")
    def bounded(vecs: pd.Series, own: pd.Series, alone: pd.Series) -> pd.Series:
        """The 2 (k + 1)-th smallest distance to the sample: no true neighbour is farther."""
        deep = 2 * k + 1
        known, single, only = held.value
        if len(known) <= deep or not len(vecs):
            return pd.Series(np.full(len(vecs), np.inf, np.float32))
        out = []
        for a in range(0, len(vecs), 256):
            part = narrow(vecs[a:a + 256], scale)
            d = distances(np.c_[part, np.zeros(len(part), np.float32)], known)
            d[alone.to_numpy()[a:a + 256, None] & single & (own.to_numpy()[a:a + 256, None] == only)] = np.inf
            out.append(np.partition(d, deep, axis=1)[:, deep])
        return pd.Series(np.concatenate(out))

    candidates = (dealt.join(F.broadcast(spread), "list")
                  .select("list", (F.xxhash64("rep") % F.col("cells")).alias("cell"), "rep", "vec", "single", "only"))
    candidates = candidates.withColumn("cell", F.abs("cell").cast("int"))
    asking = x.where(is_query).select("id", "vec")
    # ids with several vectors, each in SALTS rows so that no id's queries are one task's
    several = materialize(asking.groupBy("id").count().where("count > 1").select(
        "id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("alone")))
    salted = asking.withColumn("salt", F.pmod(F.xxhash64("vec"), F.lit(SALTS)).cast("int"))
    asking = salted.join(several, ["id", "salt"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    asking = materialize(asking.withColumn("own", F.when(F.col("alone"), F.col("id")).otherwise(0)).select(
        F.xxhash64("vec", "own", "alone").alias("q"), "id", "vec", "own", "alone"))
    asked = materialize(asking.select("q", "vec", "own", "alone").distinct().withColumn("bound", bounded("vec", "own", "alone")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")

    def through(queries: DataFrame, which: Column) -> DataFrame:
        """The k + 1 best distinct vectors of each query within its lists."""
        probing = (queries.select(F.col("q").alias("rep"), "vec", "own", "alone", "bound", F.explode(which).alias("list"))
                   .join(F.broadcast(spread), "list")
                   .select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "rep", "vec", "own", "alone", "bound"))
        found = candidates.groupBy("list", "cell").cogroup(probing.groupBy("list", "cell")).applyInPandas(
            _cell(k + 1, float(longest), rotation(dim + 1), scale), "q bigint, rep bigint, score double")
        return materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))

    near = through(asked, probed("vec"))
    enough = near.groupBy("q").count().where(F.col("count") >= min(k + 1, n)).select("q")
    short = materialize(asked.join(enough, "q", "left_anti"))
    if not short.isEmpty():
        every = F.sequence(F.lit(0), F.lit(len(centers) - 1))
        again = through(short.withColumn("bound", F.lit(float("inf")).cast("float")), every)
        near = near.join(short.select("q"), "q", "left_anti").unionByName(again)
    named = near.join(reps.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
    named = named.join(asked.select("q", "own", "alone"), "q").where(~(F.col("alone") & (F.col("own") == F.col("id"))))
    # k + 1 per distinct query, in order: one may be the asking row itself (its id has no other vector)
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = (named.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).groupBy("q")
           .agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near")))
    asks = asking.select(F.col("id").alias("query_id"), "q").join(top, "q")
    others = F.slice(F.filter("near", lambda r: r["id"] != F.col("query_id")), 1, k)
    return asks.select("query_id", F.posexplode(others).alias("at", "r")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score"))
