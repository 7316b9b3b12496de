"""Queries: sources and sinks round trips (IO2-IO4, IO6, IO8), all writing
into the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codepref.operators.sampling import assign_split
from codepref.operators.sanitize import assemble_prompts
from codepref.plans.catalog import register
from codepref.plans.sql_parts import sql_hash
from codepref.session import checkpoint_dir
from codepref.sources import tables as io

SEED = 11
H = sql_hash("doc_id", SEED)
H1, H2 = sql_hash("doc_id", SEED, 1), sql_hash("doc_id", SEED, 2)
SPLIT = f"CASE WHEN {H1} % 100 < 15 THEN 'test' WHEN {H2} % 100 < 11 THEN 'validation' ELSE 'train' END"


def _scratch(spark, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@register("io02_train_dev", f"""
WITH d AS (SELECT doc_id AS row_id, lang AS language, {SPLIT} AS split FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {sql_hash('row_id', SEED)}, row_id) AS rn
      FROM d WHERE language = 'en' AND split IN ('train', 'validation'))
SELECT row_id, split FROM r WHERE (split = 'train' AND rn <= 300) OR (split = 'validation' AND rn <= 40)
""")
def io02_train_dev(spark, sf_dir):
    """IO2: train and validation of one language with a train cap and a dev cap."""
    root = _scratch(spark, "io02")
    d = io.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"),
                                                          F.col("lang").alias("language"))
    io.write_dataset(assign_split(d, key="row_id", seed=SEED), root, "docs")
    train, dev = io.read_train_dev(spark, root, "docs", "en", size=300, dev_cap=40, seed=SEED)
    return train.select("row_id", "split").unionByName(dev.select("row_id", "split"))


@register("io03_problems", """
SELECT CAST(item_id AS VARCHAR) AS task_id, 'python' AS language, text AS prompt, 'bench_a' AS benchmark
FROM benchmark
""")
def io03_problems(spark, sf_dir):
    """IO6 then IO3: problems written as JSON Lines, read back with an explicit schema."""
    path = _scratch(spark, "io03")
    b = io.read_table(spark, sf_dir, "benchmark")
    io.write_predictions_jsonl(b.select(F.col("item_id").cast("string").alias("task_id"),
                                        F.lit("python").alias("language"), F.col("text").alias("prompt")), path)
    return io.read_problems(spark, path, benchmark="bench_a")


@register("io04_templates", """
SELECT b.item_id, t.name, t.template || b.text AS full_prompt
FROM benchmark b CROSS JOIN (VALUES ('plain', 'Task:'), ('doc', 'Write the function:' || chr(10) || chr(10) || 'Doc:')) AS t(name, template)
""")
def io04_templates(spark, sf_dir):
    """IO4 + N14: whole-text template files (a fixed number of them, written with
    outer white space) read as (name, stripped template) and joined with every item."""
    path = _scratch(spark, "io04")
    files = spark.createDataFrame([("plain", " \t\nTask:\n\n"), ("doc", "Write the function:\n\nDoc: \n")],
                                  "template_name string, value string")
    files.coalesce(1).write.partitionBy("template_name").text(path)
    t = io.read_templates(spark, path, strip=True).select(F.col("template_name").alias("name"), "template")
    b = io.read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return assemble_prompts(b, t, prompt="text").select("item_id", "name", "full_prompt")


@register("io08_names", """
SELECT doc_id, lang || '-' || source || '-1.' || CAST(doc_id % 10 AS VARCHAR) || 'b-base-'
       || CASE doc_id % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'one.shot' WHEN 2 THEN 'v1.2' ELSE '.hidden' END
       || CASE WHEN doc_id % 3 + 1 > 1 THEN '-' || CAST(doc_id % 3 + 1 AS VARCHAR) ELSE '' END AS out_name
FROM documents
""")
def io08_names(spark, sf_dir):
    """IO8: output-name rule on model names with slashes and dots and prompt paths
    with and without extensions (only the prompt path loses its extension)."""
    d = io.read_table(spark, sf_dir, "documents")
    model = F.concat(F.lit("org/"), F.col("source"), F.lit("-1."), (F.col("doc_id") % 10).cast("string"), F.lit("b-base"))
    paths = F.array(*[F.lit(p) for p in ("prompts/simple.txt", "prompts/a.b/one.shot.txt", "v1.2.md", "p/.hidden")])
    prompt = F.element_at(paths, (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", io.output_name(F.col("lang"), model, prompt_path=prompt,
                                             k=(F.col("doc_id") % 3 + 1)).alias("out_name"))
