"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled (hash) order. A document's
virtual finish time is its source's running word count divided by the source's
target; the queues are merged by a global range sort on it and cut where the
running total reaches the budget. A source whose target is above its size is
read again, at most ``repeats`` times in all.

Targets: the budget is shared by weight, a source's target stops at ``repeats``
times its size, and what is over goes to the others by weight until none is
above. That is one water level L with target = min(repeats * size, L * weight),
found from running sums over the sources in order of size / weight.

Rows are shuffled by the hash of their id, rows without one by that of their text, and
rows with one id by their texts' hashes, so only equal rows are in the order of the
table: however its rows lie in files, the same rows are taken as often.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are taken, with 0 words, when their turn
comes; repeated rows are separate documents. With no words at all, all targets
are 0 and every row is taken once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codepref.llm.common import WORD, hash60, materialize, running_total

WEIGHTS = (5, 2, 1)
REPEATS = 3


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS,
                   share: float = 1.0) -> DataFrame:
    """One row per source: idx (from 1), source, source_size, weight, target. The
    windows run over one short row per source."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    src = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("idx", F.row_number().over(by_name))
           .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                              ((F.col("idx") - 1) % len(weights) + 1).cast("int"))))
    cap = (F.col("source_size") * repeats).cast("double")
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "idx")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0))
    rest = F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(
        F.sum("source_size").over(before) * repeats, F.lit(0))
    left = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the level as if all before were at their cap; the true one is the highest
    level = F.max(F.col("_level")).over(everywhere)
    return (src.withColumn("_level", rest / left).withColumn("_level", level)
            .withColumn("target", F.greatest(F.lit(0.0), F.least(cap, F.col("_level") * F.col("weight")))).drop("_level"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0,
        seed: str = ":mix", row: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, finish) per row of
    ``docs``: words and copies the mix takes, and the first copy's finish time.
    With ``row``, a column that numbers the rows, also that column."""
    tie = F.col(row) if row else F.monotonically_increasing_id()
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                                    size_in_words(F.col("text")).alias("size"), tie.alias("tie"),
                                    F.when(F.col("doc_id").isNull(), hash60(F.col("text"), seed + ":text"))
                                    .otherwise(hash60(F.col("doc_id"), seed)).alias("h"), F.xxhash64("text").alias("t")))
    src = materialize(source_targets(sized, weights, repeats, share))
    named = sized.withColumn("k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    keyed = src.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("k"), "idx", "source_size", "target")
    queued = running_total(named.join(keyed, "k").drop("k", "source"), ["idx"], ["h", "doc_id", "t", "tie"], "size", "cum")
    passes = F.when(F.col("target") > 0, F.least(F.lit(repeats), F.ceil(F.col("target") / F.col("source_size")))).otherwise(1)
    finish = F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("cum")) / F.col("target")).otherwise(0.0)
    turns = (queued.withColumn("pass", F.explode(F.sequence(F.lit(0), passes.cast("int") - 1)))
             .withColumn("finish", finish))
    merged = running_total(turns, [], ["finish", "idx", "pass", "h", "doc_id", "t", "tie"], "size", "total")
    budget = src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    kept = F.col("total") <= F.lit(float(budget))
    taken = (merged.groupBy("tie", "doc_id", "size", "source_size", "target")
            .agg(F.sum(F.when(kept, F.col("size")).otherwise(0)).alias("taken"), F.count(F.when(kept, 1)).alias("copies"),
                 F.min("finish").alias("finish")))
    return taken.withColumnRenamed("tie", row) if row else taken.drop("tie")
