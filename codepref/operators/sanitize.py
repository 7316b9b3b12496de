"""Prediction handling (N11-N18): sanitise, prompt assembly, replication,
batch prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepref.functions.text import extract_completion, remove_markers


def sanitize(df: DataFrame, prediction: str = "completion", prompt: str = "prompt",
             language: str = "language", compat_first_row_language: str | None = None) -> DataFrame:
    """N13 + N18: keep the raw prediction as ``original_prediction`` and
    ``middle_prediction``; ``completion`` = extracted body, plus ``\\n}`` for
    Java. The language is read per row (the reference takes the first row's
    for all; pass it as ``compat_first_row_language`` to mimic that)."""
    lang = F.lit(compat_first_row_language) if compat_first_row_language else F.col(language)
    raw = F.col(prediction)
    if dict(df.dtypes).get(prediction, "").startswith("array"):
        raw = unwrap_single(raw)  # N17
    code = extract_completion(remove_markers(raw), F.col(prompt))
    code = F.when(lang == "java", F.concat(code, F.lit("\n}"))).otherwise(code)
    out = (df.withColumn("_raw", raw)
             .withColumn("original_prediction", F.col("_raw"))
             .withColumn("middle_prediction", F.col("_raw"))
             .withColumn("completion", code))
    drop = [c for c in ("_raw",) if c in out.columns]
    if prediction not in ("completion",):
        drop.append(prediction)
    return out.drop(*drop)


def assemble_prompts(problems: DataFrame, templates, prompt: str = "prompt", spread: int = 16) -> DataFrame:
    """Every template x every problem, prompt = template + problem.

    ``templates`` is a list of (name, template) pairs, exploded per problem as a
    literal array, or a (name, template) DataFrame of any size. A table is
    joined: each problem is dealt to one of ``spread`` parts and each template is
    in every part, so the optimizer broadcasts a small table and otherwise no
    part is one task's."""
    if isinstance(templates, DataFrame):
        own = templates.select("name", "template").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.lit(int(spread) - 1))))
        part = F.pmod(F.xxhash64(F.col(prompt)), F.lit(int(spread))).cast("int")
        return (problems.withColumn("_part", part).join(own, "_part").drop("_part")
                .withColumn("full_prompt", F.concat(F.col("template"), F.col(prompt))))
    lit = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("template")) for n, t in templates])
    return (problems.withColumn("_t", F.explode(lit))
            .select("*", F.col("_t.name").alias("name"), F.col("_t.template").alias("template"))
            .drop("_t")
            .withColumn("full_prompt", F.concat(F.col("template"), F.col(prompt))))


def replicate(df: DataFrame, k: int, draws: bool = True) -> DataFrame:
    """``k`` rows per sample with ``sample_id`` 1..k (no shuffle). With
    ``draws=True`` the predictor is asked for k draws (sample_id is passed);
    ``False`` copies one draw, as the reference does."""
    out = df.withColumn("sample_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(int(k)).cast("bigint"))))
    return out if draws else out.withColumn("draw", F.lit(1))


def predict(df: DataFrame, predictor_factory: Callable[[], Callable[[list[str]], list[str]]],
            prompt: str = "full_prompt", out: str = "prediction", batch_size: int = 8) -> DataFrame:
    """Add a prediction column by a pluggable batch predictor.

    ``predictor_factory`` is called once per task (a model loads once per
    task, not per row); it returns ``list[str] -> list[str]`` applied to
    fixed-size batches. Runs as ``mapInPandas`` over Arrow batches."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = predictor_factory()
        for pdf in frames:
            preds: list[str] = []
            prompts = pdf[prompt].tolist()
            for i in range(0, len(prompts), batch_size):
                preds.extend(model(prompts[i:i + batch_size]))
            yield pdf.assign(**{out: preds})

    return df.mapInPandas(run, schema)


def stub_predictor() -> Callable[[list[str]], list[str]]:
    """Deterministic stand-in model for tests: echoes the prompt and writes a
    one-line body holding the prompt length."""
    def model(prompts: list[str]) -> list[str]:
        return [f"{p}\n    return {len(p)}\nprint()" for p in prompts]
    return model


def unwrap_single(c: Column) -> Column:
    """The one-element prediction list -> its string."""
    return F.try_element_at(c, F.lit(1))
