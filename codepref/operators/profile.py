"""Profiling (A3, A4): token-length histograms and row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codepref.functions.text import WORD_CHARS

TOKEN_RE = f"[{WORD_CHARS}]+|\\S"


def token_count(text: Column) -> Column:
    """Token count stand-in for a model tokenizer: ``\\w+|\\S`` tokens,
    counted without building the token array."""
    return F.regexp_count(text, F.lit(TOKEN_RE))


def length_histogram(df: DataFrame, length: Column, bucket_size: int = 100, cap: int = 2000,
                     compat: bool = False) -> DataFrame:
    """A3: bucket = length // size after capping; label ``lo-hi``, where the
    last bucket's hi is the true maximum length. Default clamps lengths above
    ``cap`` to ``cap``; ``compat`` maps them to 1000 as the reference does.

    One aggregate with map-side combine; the max rides along in the same pass
    and the label fix-up is a window over the (few) bucket rows."""
    capped = F.when(length > cap, F.lit(1000 if compat else cap)).otherwise(length)
    b = df.select(F.floor(capped / bucket_size).cast("bigint").alias("bucket"), length.alias("_len"))
    g = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.max("_len").alias("_m"))
    w = Window.partitionBy(F.lit(0))
    g = g.withColumn("_max", F.max("_m").over(w)).withColumn("_last", F.max("bucket").over(w))
    lo = F.col("bucket") * bucket_size
    hi = F.when(F.col("bucket") == F.col("_last"), F.col("_max")).otherwise((F.col("bucket") + 1) * bucket_size - 1)
    return (g.select("bucket", F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")).alias("label"), "count")
            .orderBy("bucket"))  # W1: buckets by lower bound (a handful of rows)


def row_counts(tables: dict[str, DataFrame], by: dict[str, str] | None = None) -> DataFrame:
    """A4: rows per table, or per (table, group column value)."""
    by = by or {}
    parts = []
    for name, df in tables.items():
        key = by.get(name)
        g = (df.groupBy(F.col(key).cast("string").alias("group")) if key
             else df.groupBy(F.lit(None).cast("string").alias("group")))
        parts.append(g.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "group", "n_rows"))
    return reduce(DataFrame.unionByName, parts)
