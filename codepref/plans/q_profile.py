"""Queries: profiling (A3 histograms, A4 counts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codepref.operators.profile import length_histogram, row_counts, token_count
from codepref.plans.catalog import register
from codepref.sources.fixtures import oracle_ctes, view
from codepref.sources.tables import read_table

TOK = r"[\p{L}\p{N}_]+|\S"


def _hist_sql(table: str, col: str, size: int, cap: int, repl: int) -> str:
    return f"""
WITH l AS (SELECT len(regexp_extract_all({col}, '{TOK}')) AS n FROM {table}),
b AS (SELECT CAST(floor((CASE WHEN n > {cap} THEN {repl} ELSE n END) / {size}) AS BIGINT) AS bucket, n FROM l),
g AS (SELECT bucket, count(*) AS count, max(n) AS m FROM b GROUP BY bucket)
SELECT bucket, CAST(bucket * {size} AS VARCHAR) || '-' || CAST(CASE WHEN bucket = (SELECT max(bucket) FROM g)
       THEN (SELECT max(m) FROM g) ELSE (bucket + 1) * {size} - 1 END AS VARCHAR) AS label, count FROM g
"""


@register("a03_histogram", _hist_sql("documents", "text", 100, 2000, 2000))
def a03_histogram(spark, sf_dir):
    """A3: token-length histogram of documents (buckets of 100, clamp 2000)."""
    d = read_table(spark, sf_dir, "documents")
    return length_histogram(d, token_count(F.col("text")), 100, 2000)


@register("a03_histogram_compat", _hist_sql("conversations", "text", 50, 2000, 1000))
def a03_histogram_compat(spark, sf_dir):
    """A3 literal: conversation turns, buckets of 50, lengths > 2000 counted as 1000."""
    c = read_table(spark, sf_dir, "conversations")
    return length_histogram(c, token_count(F.col("text")), 50, 2000, compat=True)


@register("a04_counts", """
SELECT 'documents' AS "table", lang AS "group", count(*) AS n_rows FROM documents GROUP BY lang
UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role
UNION ALL SELECT 'benchmark', NULL, count(*) FROM benchmark
UNION ALL SELECT 'labels', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY quality
UNION ALL SELECT 'embeddings', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY label
""")
def a04_counts(spark, sf_dir):
    """A4: row counts per table and group."""
    t = {n: read_table(spark, sf_dir, n) for n in ("documents", "conversations", "benchmark", "labels", "embeddings")}
    return row_counts(t, {"documents": "lang", "conversations": "role", "labels": "quality", "embeddings": "label"})


@register("a03_prediction_lengths", oracle_ctes("code_base").rstrip() + ",\n"
          + _hist_sql("code_base", "prediction", 50, 2000, 2000).strip().replace("WITH l AS", "l AS", 1))
def a03_prediction_lengths(spark, sf_dir):
    """A3 on model output: token lengths of the raw predictions (buckets of 50)."""
    b = view(spark, sf_dir, "code_base")
    return length_histogram(b, token_count(F.col("prediction")), 50, 2000)
