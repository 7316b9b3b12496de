"""ST1: incremental labelling with Structured Streaming.

New base rows arrive as parquet files; each micro-batch gets the same column
functions as the batch path (N11 markers, N12 extraction, validity flag) and
is written by ``foreachBatch`` to its own ``epoch=<id>`` folder with
overwrite, so a replayed epoch (after a failure) rewrites the same files:
the sink is idempotent and the checkpoint makes the source exactly-once.
``trigger(availableNow=True)`` drains what is there and stops. Quotas (P3)
need totals, so they run as a batch step on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepref.functions.text import extract_completion, remove_markers, whole_function
from codepref.operators.validity import valid_code


def label_columns(df: DataFrame) -> DataFrame:
    code = extract_completion(remove_markers(F.col("prediction")), F.col("prompt"))
    d = df.select("row_id", "language", "function_def", code.alias("code"))
    return d.select("row_id", "language", "code",
                    valid_code(whole_function(F.col("function_def"), F.col("code")), F.col("language")).alias("valid"))


def label_stream(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str,
                 checkpoint: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the incremental labelling to completion and return the output table."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    labelled = label_columns(reader.parquet(source_dir))

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    q = (labelled.writeStream.foreachBatch(write_epoch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(
        T.StructType([T.StructField("row_id", T.LongType()), T.StructField("language", T.StringType()),
                      T.StructField("code", T.StringType()), T.StructField("valid", T.BooleanType()),
                      T.StructField("epoch", T.LongType())])).parquet(out_dir)
