"""Table sources and sinks (IO1-IO9).

Tables are addressed by (name, language, split[, revision]) as in the
reference; on disk that is a parquet table partitioned by language and split,
with the revision as a path segment, so a read of one (language, split) is a
partition-pruned scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """IO1 for the driver tables: one parquet file per table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_path(root: str, name: str, revision: str = "main") -> str:
    return f"{root.rstrip('/')}/{name}/revision={revision}"


def read_dataset(spark: SparkSession, root: str, name: str, language: str | None = None,
                 split: str | None = None, revision: str = "main") -> DataFrame:
    """IO1: read one (table, language, split); the predicates prune partitions."""
    df = spark.read.parquet(table_path(root, name, revision))
    if language is not None:
        df = df.where(F.col("language") == language)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def write_dataset(df: DataFrame, root: str, name: str, revision: str = "main",
                  files_per_partition: int | None = None, max_records_per_file: int = 1_000_000) -> str:
    """IO5: write under (name, revision) partitioned by language and split.

    Dynamic partition overwrite replaces only the (language, split) partitions
    present in ``df``; a re-run after a lost executor rewrites the same files.
    No shuffle by the partition columns: with one language holding a third of
    the rows that would put a third of the table into one task. Every task
    writes its own files (at most ``max_records_per_file`` rows each); pass
    ``files_per_partition`` to get fewer, larger files through a salted
    repartition that spreads each (language, split) over that many tasks."""
    path = table_path(root, name, revision)
    spark = df.sparkSession
    if files_per_partition:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(int(files_per_partition)))
        df = df.repartition(F.col("language"), F.col("split"), salt)
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        (df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
           .partitionBy("language", "split").parquet(path))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)
    return path


def read_train_dev(spark: SparkSession, root: str, name: str, language: str,
                   size: int | None = None, dev_cap: int = 2000, seed: int = 0):
    """IO2: train and validation of one language; with a train cap the dev side
    is capped at ``dev_cap`` (deterministic, X1)."""
    from codepref.operators.sampling import take_first

    train = read_dataset(spark, root, name, language, "train")
    dev = read_dataset(spark, root, name, language, "validation")
    if size is not None:
        train = take_first(train, size, key="row_id", seed=seed)
        dev = take_first(dev, dev_cap, key="row_id", seed=seed)
    return train, dev


PROBLEM_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("prompt", T.StringType()),
])


def read_problems(spark: SparkSession, path: str, schema: T.StructType = PROBLEM_SCHEMA,
                  benchmark: str | None = None) -> DataFrame:
    """IO3: benchmark problems as JSON Lines with an explicit schema (no
    inference pass); the benchmark name becomes a column."""
    df = spark.read.schema(schema).json(path)
    return df.withColumn("benchmark", F.lit(benchmark)) if benchmark else df


def read_templates(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """IO4: prompt templates, one whole file per row: (name = file stem,
    template, partition columns if any).

    ``strip=True`` matches the evaluation side (stripped text), ``False`` the
    base-collection side (raw text)."""
    df = (spark.read.text(path, wholetext=True)
          .withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
          .withColumnRenamed("value", "template"))
    if strip:
        from codepref.functions.text import py_strip
        df = df.withColumn("template", py_strip(F.col("template")))
    return df


def write_predictions_jsonl(df: DataFrame, path: str) -> str:
    """IO6: predictions as JSON Lines for an external scorer."""
    df.write.mode("overwrite").json(path)
    return path


def last_segment(path: Column | str) -> Column:
    """The part of a path or model name after its last slash (dots stay)."""
    return F.element_at(F.split(path if isinstance(path, Column) else F.lit(path), "/"), -1)


def path_stem(path: Column | str) -> Column:
    """A file path's last segment without its extension; a leading dot is no extension."""
    return F.regexp_replace(last_segment(path), r"(?<=.)\.[^.]+$", "")


def output_name(*parts: Column | str, prompt_path: Column | str | None = None,
                k: Column | int | None = None) -> Column:
    """IO8: output-name rule: the last segments of language and model, then the
    stem of the prompt path, joined by '-', and a ``-k`` suffix when k > 1. Only
    the prompt path loses its extension: model names keep their dots."""
    cols = [last_segment(p) for p in parts]
    name = F.concat_ws("-", *cols, *([path_stem(prompt_path)] if prompt_path is not None else []))
    if k is None:
        return name
    kc = k if isinstance(k, Column) else F.lit(k)
    return F.when(kc > 1, F.concat(name, F.lit("-"), kc.cast("string"))).otherwise(name)


RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("not_compile", T.DoubleType()),
])


def read_run_grid(spark: SparkSession, path: str, schema: T.StructType = RUN_SCHEMA) -> DataFrame:
    """IO9: the run grid (one JSON object per run) as a table; the shell loop
    over config files becomes a join with results (J4)."""
    return spark.read.schema(schema).json(path)
