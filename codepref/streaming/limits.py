"""ST2: take and skip of a stream: the first ``n`` rows over all micro-batches.

The number of rows seen so far is the stream's state: each micro-batch leaves a count
file next to its output, written last, and a batch adds up the counts of the batches
before it. A replayed batch overwrites its own output and count, so restarts neither
lose nor repeat rows. Rows are first by batch, then by a seeded hash of their key, and
the cut inside a batch is the exact quota of the batch operators: no task sees all rows,
which a stateful operator with one global key would need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepref.operators.sampling import materialize, rank_bands
from codepref.sources.commits import Folder


def split_stream(stream: DataFrame, n: int, out_dir: str, checkpoint: str, key: str = "row_id", seed: int = 0) -> None:
    """Run the stream until its input is used up, and write its rows to ``out_dir`` with
    the column ``first``: whether a row is one of the first ``n``. Keys must not be null."""
    spark = stream.sparkSession
    counts = Folder(spark, f"{out_dir.rstrip('/')}/_counts")

    def write_batch(batch: DataFrame, epoch: int) -> None:
        rows = materialize(batch)
        before = sum(c["rows"] for c in (counts.read(name) for name in counts.names()) if c["epoch"] < epoch)
        left = max(0, n - before)
        banded = rank_bands(rows, [left], key=key, seed=seed, out="_band")
        marked = banded.withColumn("first", F.col("_band") == 0).drop("_band")
        marked.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch}")
        counts.add(f"{epoch:012d}.json", {"epoch": epoch, "rows": rows.count()}, replace=True)

    (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _finished(spark: SparkSession, out_dir: str) -> DataFrame:
    counts = Folder(spark, f"{out_dir.rstrip('/')}/_counts")
    epochs = [counts.read(name)["epoch"] for name in counts.names()]
    paths = [f"{out_dir.rstrip('/')}/epoch={e}" for e in epochs]
    return spark.read.option("basePath", out_dir).parquet(*paths)


def taken(spark: SparkSession, out_dir: str) -> DataFrame:
    """The first rows of a stream that :func:`split_stream` has run."""
    return _finished(spark, out_dir).where("first").drop("first")


def skipped(spark: SparkSession, out_dir: str) -> DataFrame:
    """All rows but the first."""
    return _finished(spark, out_dir).where("not first").drop("first")
