"""IO7 and ST2: runs that are killed and restarted; F13 without a counting pass."""

import pytest
from pyspark.sql import functions as F

from codepref.operators import filters as flt
from codepref.operators.sampling import materialize
from codepref.sources.commits import CommitLog, predict_resumably
from codepref.sources.fixtures import view
from codepref.streaming.limits import skipped, split_stream, taken

from tests.conftest import SF_SMALL


def _predictor(path):
    """A predictor that leaves a file per prompt, so that calls can be counted."""
    def factory():
        def model(prompts):
            import uuid
            for p in prompts:
                with open(f"{path}/{p}-{uuid.uuid4().hex}", "w"):
                    pass
            return [p.upper() for p in prompts]
        return model
    return factory


def test_killed_run_resumes(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "row_id bigint, full_prompt string")
    calls = tmp_path / "calls"
    calls.mkdir()
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.read() is None
    assert predict_resumably(rows, _predictor(calls), log, "row_id", batches=4, at_most=1) == 1
    first = log.read().count()
    # killed after the data is written and before its manifest is
    add = log._manifests.add
    monkeypatch.setattr(log._manifests, "add", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        predict_resumably(rows, _predictor(calls), log, "row_id", batches=4)
    monkeypatch.setattr(log._manifests, "add", add)
    assert log.read().count() == first
    predict_resumably(rows, _predictor(calls), CommitLog(spark, str(tmp_path / "log")), "row_id", batches=3)
    done = log.read()
    assert sorted((r["row_id"], r["prediction"]) for r in done.collect()) == [(i, f"P{i}") for i in range(40)]
    # only the killed part was predicted twice
    times = [len(list(calls.glob(f"p{i}-*"))) for i in range(40)]
    assert set(times) <= {1, 2} and times.count(2) < 40 - first
    assert [m["revision"] for m in log.revisions()] == list(range(1, len(log.revisions()) + 1))
    assert log.read(upto=1).count() == first
    assert predict_resumably(rows, _predictor(calls), log, "row_id") == 0


def test_two_writers_take_different_revisions(spark, tmp_path):
    a, b = (CommitLog(spark, str(tmp_path / "log")) for _ in range(2))
    names = b._manifests.names
    a.commit(spark.range(3))
    seen = iter([[], names()])
    b._manifests.names = lambda: next(seen)  # looked before the other one committed
    assert b.commit(spark.range(3, 5)) == 2
    assert sorted(r[0] for r in a.read().select("id").collect()) == [0, 1, 2, 3, 4]


def test_stream_take_and_skip_over_restarts(spark, tmp_path):
    total = 0
    for step in range(4):
        spark.range(step * 25, step * 25 + 25).select(F.col("id").alias("row_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        total += 25
        split_stream(spark.readStream.schema("row_id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 60, str(tmp_path / "out"), str(tmp_path / "ck"))
        first = {r[0] for r in taken(spark, str(tmp_path / "out")).select("row_id").collect()}
        rest = {r[0] for r in skipped(spark, str(tmp_path / "out")).select("row_id").collect()}
        assert len(first) == min(60, total) and len(rest) == max(0, total - 60) and not first & rest
    assert {i for i in range(50)} <= first and {i for i in range(75, 100)} <= rest


def test_observed_funnel(spark):
    seed = view(spark, SF_SMALL, "code_seed")
    rows, found = flt.observed_funnel(seed)
    kept = materialize(flt.filter_seed(rows).select("row_id"))
    got = sorted(map(tuple, flt.funnel_rows(spark, found).collect()))
    assert got == sorted(map(tuple, flt.funnel(seed).collect()))
    assert sorted(r[0] for r in kept.collect()) == sorted(r["row_id"] for r in flt.filter_seed(seed).collect())
