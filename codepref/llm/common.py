"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codepref.session import checkpoint_dir

# The ASCII white space between words (fixed value of the word contracts).
SPACE_BYTES = rb"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the session's shared checkpoint folder and
    read it back: the lineage is cut, several readers share one computation, and
    a lost executor only re-reads files."""
    path = scratch(df.sparkSession, "tables")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash60(col: Column, salt: str = "") -> Column:
    """The first 60 bits of the md5 of a value as text (null: the empty text)."""
    text = F.concat(F.coalesce(col.cast("string"), F.lit("")), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of a value as text, modulo ``mod``; -1 for a null value."""
    return F.coalesce(F.crc32(col.cast("string")) % mod, F.lit(-1))


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str,
                  out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per group in the given order, without
    ever sorting a whole group in one task.

    Rows are range-partitioned by (groups, order), which cuts a hot group into
    many ranges; the sum per (range, group) is a table of about one row per
    partition and group, its own running sum gives each range its offset, and
    a window inside the range does the rest. The ranges are written before they
    are summed, so a lost executor can't change them between the two reads.
    ``order`` should end in a unique column; group columns must not be null."""
    d = df.repartitionByRange(*[F.col(c) for c in [*groups, *order]])
    d = materialize(d.withColumn("_pid", F.spark_partition_id()))
    sums = d.groupBy("_pid", *groups).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*([F.col(g) for g in groups] or [F.lit(0)])).orderBy("_pid")
    offset = F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_pid", *groups, offset.alias("_offset"))
    inside = (Window.partitionBy("_pid", *groups).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    return (d.join(offsets, ["_pid", *groups])
            .withColumn(out, F.col("_offset") + F.sum(value).over(inside)).drop("_pid", "_offset"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the
    smallest node reachable, one row per node that has an edge.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is
    a min per node (map-side combined) joined back to the edges, so a hub's
    neighbours are never collected. Each round is written to the checkpoint
    folder; the rounds end when a round leaves the edge set as it was."""
    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    a, b = edges.columns
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u <> v").distinct())
    e = materialize(e)
    seen = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u")
        small = (down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small)
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def one_of(cols: Iterable[str], stem: str) -> str:
    """A column name that none of ``cols`` has, whatever their case."""
    taken = {c.lower() for c in cols}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def make_way(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` with its columns that have one of ``names`` (whatever their case)
    renamed by trailing underscores, so that an operator can add its own."""
    out, names = df, [n.lower() for n in names]
    for c in df.columns:
        if c.lower() in names:
            out = out.withColumnRenamed(c, one_of([*out.columns, *names], c))
    return out
