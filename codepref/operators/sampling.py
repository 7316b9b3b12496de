"""Deterministic sampling, quotas and splits.

Spark tables have no order, so "first k" means "k smallest by a seeded md5 of
the row key" (ties broken by the key, which should be unique). The k-th
smallest (hash, key) of each group is found exactly, without a global sort and
without moving any other column:

1. count rows per (group, hash bucket) with map-side combine; a running sum
   over that small table finds the one bucket that holds rank k;
2. only the (hash, key) pairs of that bucket are numbered, which gives the
   group's cutoff;
3. the rows are scanned once and compared with their group's cutoff.

A hot group (a third of all rows) spreads over all buckets, so no task of step 2
sees more than about group_size / 2**bits short rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codepref.functions.text import seeded_hash

HASH_BITS = 32
# Cutoff tables (one short row per group) are broadcast up to this many rows.
BROADCAST_CUT_ROWS = 1_500_000


def _hash(key: str, seed: int, hash_col: str | None) -> Column:
    return F.col(hash_col) if hash_col else seeded_hash(key, seed)


def _cutoffs(df: DataFrame, bounds: DataFrame | list[int], groups: list[str], key: str, h: Column,
             bits: int) -> tuple[DataFrame, list[str]]:
    """Per group: the bounds k1..km and, for each, ``cut_<k>`` = (hash, key) of the
    row with that rank (NULL when the group has fewer rows)."""
    rows = df.select(*groups, h.alias("_h"), F.col(key).alias("_key"))
    bucket = F.shiftright("_h", HASH_BITS - bits)
    counts = rows.groupBy(*groups, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    if isinstance(bounds, DataFrame):
        ks = sorted((c for c in bounds.columns if re.fullmatch(r"k\d+", c)), key=lambda c: int(c[1:]))
        wanted = bounds.select(*groups, *ks)
    else:
        ks = [f"k{j}" for j, _ in enumerate(bounds, 1)]
        wanted = counts.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
        wanted = wanted.select(*groups, *[F.lit(int(v)).cast("bigint").alias(k) for k, v in zip(ks, bounds)])
    if isinstance(bounds, DataFrame):
        counts = counts.join(wanted, groups)
    else:
        counts = counts.select("*", *[F.lit(int(v)).cast("bigint").alias(k) for k, v in zip(ks, bounds)])
    part = [F.col(g) for g in groups] or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.withColumn("_lo", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    # the bucket that holds each bound's rank, and the rank within it
    inside = F.array(*[F.when((F.col("_lo") < F.col(k)) & (F.col(k) <= F.col("_lo") + F.col("_c")),
                              F.struct(F.lit(k).alias("k"), (F.col(k) - F.col("_lo")).alias("need"))) for k in ks])
    at = table.select(*groups, "_b", F.explode(F.array_compact(inside)).alias("_at"))
    at = materialize(at.select(*groups, "_b", "_at.k", "_at.need"))
    order = Window.partitionBy(*groups, "_b", "k").orderBy("_h", "_key")
    near = rows.withColumn("_b", bucket).join(_broadcast_if_small(at), [*groups, "_b"])
    cut = near.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == F.col("need"))
    cuts = cut.groupBy(*groups).agg(*[F.max(F.when(F.col("k") == k, F.struct(F.col("_h").alias("h"), F.col("_key").alias("key"))))
                                      .alias(f"cut_{k}") for k in ks])
    out = wanted.join(cuts, groups, "left") if groups else cuts
    if not groups:
        out = out.select("*", *[F.lit(int(v)).cast("bigint").alias(k) for k, v in zip(ks, bounds)])
    return materialize(out), ks


def _broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table is broadcast when its counted rows are few; larger ones
    are left to the optimizer."""
    return F.broadcast(table) if table.count() <= BROADCAST_CUT_ROWS else table


def hash_quota(df: DataFrame, k: int | DataFrame, groups=(), key: str = "row_id",
               seed: int = 0, hash_col: str | None = None, invert: bool = False,
               bits: int = 16) -> DataFrame:
    """Per group, the ``k`` rows with the smallest (hash, key).

    ``k`` is an int or a DataFrame (group columns + ``k``). ``invert=True``
    returns the complement (all other rows). Oracle:
    ``row_number() OVER (PARTITION BY groups ORDER BY hash, key) <= k``."""
    bounds = k.withColumnRenamed("k", "k1") if isinstance(k, DataFrame) else [k]
    banded = rank_bands(df, bounds, groups, key, seed, hash_col, out="_band", bits=bits)
    return banded.where(F.col("_band") == (1 if invert else 0)).drop("_band")


def rank_bands(df: DataFrame, bounds: DataFrame | list[int], groups=(), key: str = "row_id",
               seed: int = 0, hash_col: str | None = None, out: str = "band", bits: int = 16) -> DataFrame:
    """Generalised R3: every row gets ``band`` = how many cumulative bounds its
    rank (by (hash, key), 1-based, per group) exceeds. ``bounds`` is a list of
    ints or a DataFrame with the group columns and ``k1..km`` (ascending; rows of
    groups it lacks are dropped).

    The rows are scanned once: each is compared with its group's cutoffs, which
    come as a broadcast table of checked size or, without groups, as literals.
    Oracle: ``band = sum(rank > k_j)`` with ``rank = row_number() OVER
    (PARTITION BY groups ORDER BY hash, key)``."""
    groups = list(groups)
    cols = df.columns
    h = _hash(key, seed, hash_col)
    cuts, ks = _cutoffs(df, bounds, groups, key, h, bits)
    if groups:
        d = df.join(_broadcast_if_small(cuts), groups)
        at = {k: (F.col(k), F.col(f"cut_{k}"), F.col(f"cut_{k}.h"), F.col(f"cut_{k}.key")) for k in ks}
    else:
        row = cuts.first()
        d, at = df, {}
        for k in ks:
            cut = row[f"cut_{k}"] if row else None
            v = F.lit(int(row[k] if row else 0))
            at[k] = ((v, F.lit(None).cast("string"), F.lit(0), F.lit(0)) if cut is None
                     else (v, F.lit("cut"), F.lit(cut["h"]), F.lit(cut["key"])))
    band = F.lit(0)
    for k in ks:
        bound, cut, ch, ck = at[k]
        past = (h > ch) | ((h == ch) & (F.col(key) > ck))
        band = band + F.when(bound <= 0, 1).when(cut.isNull(), 0).when(past, 1).otherwise(0)
    return d.withColumn(out, band).select(*cols, out)


def take_first(df: DataFrame, n: int, key: str = "row_id", seed: int = 0, groups=()) -> DataFrame:
    """X1 / IO2 / A2: the first ``n`` rows in seeded-hash order."""
    return hash_quota(df, n, groups, key, seed)


def skip_first(df: DataFrame, n: int = 200, key: str = "row_id", seed: int = 0, groups=()) -> DataFrame:
    """Every row except the first ``n`` in seeded-hash order."""
    return rank_bands(df, [n], groups, key, seed, out="_band").where("_band = 1").drop("_band")


def shuffle_rows(df: DataFrame, key: str = "row_id", seed: int = 0,
                 partitions: int | None = None) -> DataFrame:
    """A seeded, reproducible shuffle: range-partition by the hash and sort
    inside partitions (no single-partition sort)."""
    h = seeded_hash(key, seed)
    args = [partitions] if partitions else []
    return (df.withColumn("_h", h).repartitionByRange(*args, "_h")
            .sortWithinPartitions("_h", key).drop("_h"))


def assign_split(df: DataFrame, key: str = "row_id", seed: int = 0, test_pct: int = 15,
                 validation_pct: int = 11, exact: bool = False, groups=()) -> DataFrame:
    """Three-way split, ``test_pct`` % test, then ``validation_pct`` % of the
    rest validation. Default: hash buckets (a row keeps its split when the table
    grows). ``exact=True``: exactly ceil(test_pct% of n) test rows and
    ceil(validation_pct% of the rest) validation rows per group: the first
    ranks (seeded hash order) are test, the next ones validation (R3 bands).
    The exact form reads ``df`` more than once (group counts, bucket counts,
    rows): materialize an expensive input first."""
    groups = list(groups)
    if not exact:
        h1, h2 = seeded_hash(key, seed, 1), seeded_hash(key, seed, 2)
        split = (F.when(h1 % 100 < test_pct, "test")
                 .when(h2 % 100 < validation_pct, "validation").otherwise("train"))
        return df.withColumn("split", split)
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.floor((F.col("_n") * test_pct + 99) / 100)
    n_val = F.floor(((F.col("_n") - n_test) * validation_pct + 99) / 100)
    bounds = counts.select(*groups, n_test.alias("k1"), (n_test + n_val).alias("k2"))
    out = rank_bands(df, bounds, groups, key, seed, out="_band")
    split = F.when(F.col("_band") == 0, "test").when(F.col("_band") == 1, "validation").otherwise("train")
    return out.withColumn("split", split).drop("_band")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the table as parquet into the session's shared
    checkpoint folder (``spark.checkpoint.dir``) and reading it back.

    A table read by several branches (counts, negatives, selection,
    positives) is then computed once, survives executor loss, and each branch
    reads only its columns (the counts never touch the prompt or reference
    text), which a row-serialized RDD checkpoint cannot offer."""
    import uuid

    from codepref.session import checkpoint_dir

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
