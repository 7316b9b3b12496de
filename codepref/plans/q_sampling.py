"""Queries: deterministic take / skip / shuffle / splits (X1-X4, R3, IO2, IO5)."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from codepref.operators.sampling import assign_split, hash_quota, materialize, shuffle_rows, skip_first, take_first
from codepref.plans.catalog import register
from codepref.plans.sql_parts import sql_hash
from codepref.sources.tables import read_table

SEED = 11
H = sql_hash("doc_id", SEED)
H1, H2 = sql_hash("doc_id", SEED, 1), sql_hash("doc_id", SEED, 2)


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@register("x01_take", f"""
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (ORDER BY {H}, doc_id) AS rn FROM documents) WHERE rn <= 100
""")
def x01_take(spark, sf_dir):
    """First 100 rows in seeded-hash order (exact, no global sort)."""
    return take_first(_docs(spark, sf_dir), 100, key="doc_id", seed=SEED)


@register("x01_take_per_lang", f"""
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {H}, doc_id) AS rn FROM documents) WHERE rn <= 50
""")
def x01_take_per_lang(spark, sf_dir):
    """R3 with groups: 50 rows per language (one language holds most rows)."""
    return hash_quota(_docs(spark, sf_dir), 50, ["lang"], key="doc_id", seed=SEED)


@register("x02_skip", f"""
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (ORDER BY {H}, doc_id) AS rn FROM documents) WHERE rn > 200
""")
def x02_skip(spark, sf_dir):
    """Every row but the first 200."""
    return skip_first(_docs(spark, sf_dir), 200, key="doc_id", seed=SEED)


@register("x03_shuffle", f"""
SELECT doc_id, lang, source, n_chars, row_number() OVER (ORDER BY {H}, doc_id) AS position FROM documents
""")
def x03_shuffle(spark, sf_dir):
    """Seeded shuffle (range partitions on the hash, sorted inside); position
    is the place in the shuffled table, from each partition's place and its rows."""
    rows = shuffle_rows(_docs(spark, sf_dir), key="doc_id", seed=SEED)
    rows = materialize(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), "part").select("doc_id", "lang", "source", "n_chars", place.alias("position"))


@register("x04_split", f"""
SELECT doc_id, CASE WHEN {H1} % 100 < 15 THEN 'test' WHEN {H2} % 100 < 11 THEN 'validation'
                    ELSE 'train' END AS split FROM documents
""")
def x04_split(spark, sf_dir):
    """Hash-bucket three-way split (stable under growth)."""
    return assign_split(_docs(spark, sf_dir), key="doc_id", seed=SEED).select("doc_id", "split")


@register("x04_split_exact", f"""
WITH c AS (SELECT lang, count(*) AS n, (count(*) * 15 + 99) // 100 AS k_test FROM documents GROUP BY lang),
r AS (SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY {H.replace('doc_id', 'd.doc_id')}, d.doc_id) AS r
      FROM documents d)
SELECT doc_id, lang, CASE WHEN r <= k_test THEN 'test'
                          WHEN r <= k_test + ((n - k_test) * 11 + 99) // 100 THEN 'validation'
                          ELSE 'train' END AS split FROM r JOIN c USING (lang)
""")
def x04_split_exact(spark, sf_dir):
    """X4 exact: ceil(15 %) test and ceil(11 % of the rest) validation per language."""
    return assign_split(_docs(spark, sf_dir), key="doc_id", seed=SEED, exact=True,
                        groups=["lang"]).select("doc_id", "lang", "split")


@register("io05_roundtrip", f"""
SELECT doc_id, lang AS language, CASE WHEN {H1} % 100 < 15 THEN 'test' WHEN {H2} % 100 < 11
       THEN 'validation' ELSE 'train' END AS split, n_chars
FROM documents WHERE lang = 'de'
""")
def io05_roundtrip(spark, sf_dir):
    """IO5 + IO1: write (language, split) partitions under a revision in the
    shared checkpoint folder, read one language back with partition pruning."""
    import uuid

    from codepref.session import checkpoint_dir
    from codepref.sources.tables import read_dataset, write_dataset

    root = f"{checkpoint_dir(spark).rstrip('/')}/datasets-{uuid.uuid4().hex}"
    d = assign_split(_docs(spark, sf_dir), key="doc_id", seed=SEED).withColumnRenamed("lang", "language")
    write_dataset(d.select("doc_id", "language", "split", "n_chars"), root, "documents", revision="r1")
    return read_dataset(spark, root, "documents", language="de", revision="r1").select(
        "doc_id", "language", "split", "n_chars")
