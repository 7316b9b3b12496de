"""Sinks, streaming and fingerprints."""

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from codepref.operators.evaluate import fingerprint, json_string
from codepref.session import checkpoint_dir
from codepref.sources.fixtures import view
from codepref.sources.tables import read_dataset, write_dataset
from codepref.streaming.incremental import label_stream
from tests.conftest import SF_SMALL


def test_fingerprint_matches_python_json(spark):
    recs = [(1, "plain", 7), (2, 'quo"te\\back', 0), (3, "naïve – ünïcode\n", 12), (4, "emoji 😀", 3)]
    df = spark.createDataFrame(recs, "id long, name string, size long")
    fp = fingerprint({"id": F.col("id").cast("string"), "name": json_string(F.col("name")),
                      "size": F.col("size").cast("string")})
    got = {r["id"]: r["fp"] for r in df.select("id", fp.alias("fp")).collect()}
    for i, name, size in recs:
        want = hashlib.md5(json.dumps({"size": size, "name": name, "id": i}, sort_keys=True).encode()).hexdigest()
        assert got[i] == want, name


def test_stream_replay_is_idempotent(spark):
    root = f"{checkpoint_dir(spark)}/t-stream-{uuid.uuid4().hex}"
    base = view(spark, SF_SMALL, "code_base")
    base.repartition(3, "row_id").write.parquet(f"{root}/in")
    out1 = label_stream(spark, f"{root}/in", base.schema, f"{root}/out", f"{root}/ckpt", max_files_per_trigger=1)
    n1 = out1.count()
    # a second run over the same checkpoint finds nothing new and rewrites nothing
    out2 = label_stream(spark, f"{root}/in", base.schema, f"{root}/out", f"{root}/ckpt", max_files_per_trigger=1)
    assert n1 == base.count() == out2.count()
    assert out2.select("epoch").distinct().count() == 3
    assert out2.groupBy("row_id").count().where("count > 1").count() == 0


def test_dataset_overwrite_is_idempotent(spark):
    root = f"{checkpoint_dir(spark)}/t-ds-{uuid.uuid4().hex}"
    d = view(spark, SF_SMALL, "code_seed").withColumn("split", F.lit("train"))
    write_dataset(d, root, "seed")
    write_dataset(d.where("language = 'java'"), root, "seed")   # rewrites only java/train
    back = read_dataset(spark, root, "seed")
    assert back.count() == d.count()
    assert read_dataset(spark, root, "seed", language="java", split="train").count() == \
        d.where("language = 'java'").count()


def test_run_grid_and_problem_readers(spark):
    from codepref.sources.tables import read_run_grid

    root = f"{checkpoint_dir(spark)}/t-runs-{uuid.uuid4().hex}"
    runs = spark.createDataFrame([("r0", "m", "p", "java", 7500, 1.0), ("r1", "m", "q", "python", None, 0.5)],
                                 "run_id string, model string, prompt string, language string, size long, "
                                 "not_compile double")
    runs.write.json(root)
    back = read_run_grid(spark, root)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in runs.collect())


def test_cli_jobs(spark):
    """The command-line jobs end to end on fixture-derived tables."""
    from codepref.cli import run

    root = f"{checkpoint_dir(spark)}/t-cli-{uuid.uuid4().hex}"
    view(spark, SF_SMALL, "code_raw").write.parquet(f"{root}/raw")
    s = run(["filter-seed", "--input", f"{root}/raw", "--output", root, "--name", "seed"], spark)
    assert read_dataset(spark, root, "seed").count() > 0 and len(s["funnel"]) == 3
    run(["filter-seed", "--input", f"{root}/raw", "--output", root, "--name", "seed_exact", "--exact-split"], spark)
    assert read_dataset(spark, root, "seed_exact").count() == read_dataset(spark, root, "seed").count()
    base = view(spark, SF_SMALL, "code_base").withColumn("split", F.lit("train"))
    write_dataset(base, root, "base")
    run(["kto", "--input", root, "--base-name", "base", "--output", root, "--name", "kto"], spark)
    kto = read_dataset(spark, root, "kto")
    assert kto.where("label").count() == base.count()
    run(["dpo", "--input", root, "--base-name", "base", "--output", root, "--name", "dpo",
         "--language", "java"], spark)
    assert read_dataset(spark, root, "dpo").where("language <> 'java'").count() == 0
    view(spark, SF_SMALL, "results").write.parquet(f"{root}/results")
    s = run(["score", "--input", f"{root}/results", "--k", "1", "5"], spark)
    assert s["pass_at_k"]["n_tasks"] == 49
    preds = base.select(F.col("row_id").alias("task_id"), "language", "prompt",
                        F.col("prediction").alias("completion"))
    preds.write.json(f"{root}/preds")
    s = run(["sanitize", "--input", f"{root}/preds", "--output", f"{root}/sanitized"], spark)
    assert spark.read.json(f"{root}/sanitized").count() == base.count()


def test_dataset_write_with_salted_files(spark):
    root = f"{checkpoint_dir(spark)}/t-salt-{uuid.uuid4().hex}"
    d = view(spark, SF_SMALL, "code_seed").withColumn("split", F.lit("train"))
    write_dataset(d, root, "seed", files_per_partition=3)
    assert read_dataset(spark, root, "seed").count() == d.count()


def test_code_base_moves_the_source_text_once(spark, monkeypatch):
    """The source is dealt out before the view copies its text, without a sort, into more
    parts the larger it is; the view of plain columns is not written again."""
    from codepref.sources import fixtures

    plan = fixtures.derive(spark, SF_SMALL, "code_base")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("Exchange hashpartitioning(_at") == 1 and "RoundRobin" not in text and "Sort" not in text
    dealt = plan.optimizedPlan().collectLeaves().apply(0).toString()
    assert "text" in dealt and "payload" not in dealt
    seed = view(spark, SF_SMALL, "code_seed")
    assert set(seed.inputFiles()) <= set(view(spark, SF_SMALL, "code_base").inputFiles())
    documents = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    few = fixtures.deal_out(documents).rdd.getNumPartitions()
    monkeypatch.setattr(fixtures, "PART_BYTES", 2000)
    many = fixtures.deal_out(documents)
    assert many.rdd.getNumPartitions() > few
    assert sorted(many.collect(), key=str) == sorted(documents.collect(), key=str)


def test_deal_out_spreads_copies(spark):
    from codepref.sources import fixtures

    rows = spark.createDataFrame([(None, "same")] * 4000, "doc_id long, text string")
    path = f"{checkpoint_dir(spark)}/t-copies-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(path)
    dealt = fixtures.deal_out(spark.read.parquet(path))
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 3 * 4000 / dealt.rdd.getNumPartitions()


def test_incremental_files_follow_the_table(spark, monkeypatch):
    """The stream's input comes in as many files as the table has parts, in four batches."""
    from codepref.plans import q_vectors
    from codepref.streaming import incremental

    seen = {}
    whole = incremental.label_stream

    def label(spark, source, schema, *args, max_files_per_trigger):
        seen.update(files=len(spark.read.parquet(source).inputFiles()), each=max_files_per_trigger)
        return whole(spark, source, schema, *args, max_files_per_trigger=max_files_per_trigger)

    parts = spark.range(0, 9, 1, 9).select(F.col("id").alias("_n"))
    base = view(spark, SF_SMALL, "code_base").where("row_id < 30").crossJoin(parts).where("row_id % 9 = _n").drop("_n").repartition(9, "row_id")
    monkeypatch.setattr(incremental, "label_stream", label)
    monkeypatch.setattr(q_vectors, "view", lambda *a: base)
    out = q_vectors.st1_incremental(spark, SF_SMALL)
    assert out.count() == base.count() and seen["files"] > 4 and seen["each"] == -(-seen["files"] // 4)
