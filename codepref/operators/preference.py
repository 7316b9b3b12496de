"""Preference-set builders (P1-P6): KTO rows (prompt, completion, label) and
DPO rows (prompt, rejected, chosen).

Plan: one projection labels every base row (N11 markers, N12 extraction, N8
whole function, V validity, C3 eligibility); the narrow flagged table is
written once as parquet to the shared checkpoint folder, so the (possibly
Python) checker runs once although the per-group counts, the negatives, the
selection and the positives all read it. Counts are one aggregate (one row
per group), the quota is applied by the exact hash quota (R3), and only the
chosen rows are corrupted. Natural negatives and positives need no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codepref.functions.text import extract_completion, remove_markers, whole_function
from codepref.operators.corrupt import has_eligible_line, with_corruption
from codepref.operators.sampling import hash_quota, materialize
from codepref.operators.validity import valid_code


def label_predictions(base: DataFrame, key: str = "row_id", prompt: str = "prompt",
                      prediction: str = "prediction", reference: str = "code_completion",
                      function_def: str = "function_def", language: str = "language",
                      groups=("language",), checkers: dict | None = None,
                      repair_java_brace: bool = True, compat: bool = False) -> DataFrame:
    """Flag every base row: ``code`` (extracted completion), ``valid`` and
    ``candidate`` (may be corrupted into a negative). A Java def without its
    ``{`` gets it back before the check (Q3), unless ``repair_java_brace=False``."""
    lang = F.col(language)
    code = extract_completion(remove_markers(F.col(prediction)), F.col(prompt))
    keep = list(dict.fromkeys([key, *groups, language]))
    df = base.select(*keep, F.col(prompt).alias("prompt"), F.col(function_def).alias("_def"),
                     F.col(reference).alias("reference"), code.alias("code"))
    whole = whole_function(F.col("_def"), F.col("code"), lang, repair_java_brace)
    df = df.withColumn("valid", valid_code(whole, lang, checkers))
    eligible = has_eligible_line(F.col("code"), lang)
    cand = F.col("valid") & eligible if compat else F.col("valid") & (F.col("code") != "") & eligible
    return df.withColumn("candidate", cand).withColumnRenamed("_def", "function_def")


def _quota_counts(flagged: DataFrame, groups: list[str]) -> DataFrame:
    return flagged.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("valid")).alias("neg"),
        F.count_if(F.col("candidate")).alias("candidates"),
        F.count_if(F.col("code") != "").alias("nonempty"),
        F.count_if(F.col("valid")).alias("n_valid"))


def kto_quota(counts: DataFrame, not_compile: float) -> DataFrame:
    """P3 (KTO): max(0, int(n * f / (1 - f)) - neg); 0 <= f < 1."""
    if not 0 <= not_compile < 1:
        raise ValueError("not_compile must be in [0, 1) for KTO")
    f = float(not_compile)
    target = F.floor(F.col("n") * F.lit(f) / F.lit(1.0 - f))
    return counts.withColumn("k", F.greatest(F.lit(0), target - F.col("neg")).cast("bigint"))


def dpo_quota(counts: DataFrame, not_compile: float, compat: bool = False) -> DataFrame:
    """P3 (DPO): int(f * n) - neg, clamped at 0. ``compat=True`` keeps the
    reference's negative slice: ``candidates + quota`` rows (Q5)."""
    if not_compile < 0:
        raise ValueError("not_compile must be >= 0")
    raw = F.floor(F.col("n") * F.lit(float(not_compile))) - F.col("neg")
    k = (F.when(raw >= 0, raw).otherwise(F.greatest(F.lit(0), F.col("candidates") + raw))
         if compat else F.greatest(F.lit(0), raw))
    return counts.withColumn("k", k.cast("bigint"))


def kto_rows(flagged: DataFrame, not_compile: float = 0.5, groups=("language",),
             key: str = "row_id", seed: int = 0, compat: bool = False,
             recheck: bool = False, checkers: dict | None = None) -> DataFrame:
    """P2 on a flagged table (key, groups, language, prompt, code, reference,
    valid, candidate): invalid -> label false; candidates corrupted up to the
    quota -> label false; every reference -> label true. ``flagged`` should be
    materialized (it is read by four branches)."""
    groups = list(groups)
    quota = kto_quota(_quota_counts(flagged, groups), not_compile).select(*groups, "k")
    corrupted = _corrupted(flagged, quota, groups, key, seed, compat, recheck, checkers)
    out_cols = list(dict.fromkeys([*groups, "language", key]))
    negatives = flagged.where(~F.col("valid")).select(
        *out_cols, "prompt", F.col("code").alias("completion"), F.lit(False).alias("label"))
    corrupted = corrupted.select(*out_cols, "prompt", F.col("corrupted").alias("completion"), F.lit(False).alias("label"))
    positives = flagged.select(*out_cols, "prompt", F.col("reference").alias("completion"),
                               F.lit(True).alias("label"))
    return reduce(DataFrame.unionByName, [negatives, corrupted, positives])


def dpo_rows(flagged: DataFrame, not_compile: float = 1.0, groups=("language",),
             key: str = "row_id", seed: int = 0, compat: bool = False,
             recheck: bool = False, checkers: dict | None = None) -> DataFrame:
    """P1 on a flagged table: invalid -> (prompt, rejected=code, chosen=reference);
    candidates corrupted as ``rejected`` up to ``int(f*n) - invalid``."""
    groups = list(groups)
    quota = dpo_quota(_quota_counts(flagged, groups), not_compile, compat).select(*groups, "k")
    corrupted = _corrupted(flagged, quota, groups, key, seed, compat, recheck, checkers)
    out_cols = list(dict.fromkeys([*groups, "language", key]))
    negatives = flagged.where(~F.col("valid")).select(
        *out_cols, "prompt", F.col("code").alias("rejected"), F.col("reference").alias("chosen"))
    corrupted = corrupted.select(*out_cols, "prompt", F.col("corrupted").alias("rejected"), F.col("reference").alias("chosen"))
    return negatives.unionByName(corrupted)


def build_kto(base: DataFrame, not_compile: float = 0.5, groups=("language",),
              key: str = "row_id", seed: int = 0, compat: bool = False,
              recheck: bool = False, **cols) -> DataFrame:
    """P2 from base rows: label (extraction + checker), materialize, KTO rows."""
    groups = list(groups)
    flagged = materialize(label_predictions(base, key=key, groups=groups, compat=compat, **cols))
    return kto_rows(flagged, not_compile, groups, key, seed, compat, recheck, cols.get("checkers"))


def build_dpo(base: DataFrame, not_compile: float = 1.0, groups=("language",),
              key: str = "row_id", seed: int = 0, compat: bool = False,
              recheck: bool = False, **cols) -> DataFrame:
    """P1 from base rows: label (extraction + checker), materialize, DPO rows."""
    groups = list(groups)
    flagged = materialize(label_predictions(base, key=key, groups=groups, compat=compat, **cols))
    return dpo_rows(flagged, not_compile, groups, key, seed, compat, recheck, cols.get("checkers"))


def flag_from_labels(items: DataFrame, labels: DataFrame, key: str, language: str, valid: str,
                     prompt: str = "prompt", code: str = "code", compat: bool = False,
                     carry=()) -> DataFrame:
    """Flag rows whose validity comes from an external judgement (a label
    table joined on the key) instead of a checker: the pluggable-verdict form
    of the flag step. Inner equi join on a unique key (no hot key); ``carry``
    names item columns kept as they are (e.g. group columns)."""
    j = items.join(labels, key)
    d = j.select(key, *carry, F.col(language).alias("language"), F.col(prompt).alias("prompt"),
                 F.col(code).alias("code"), F.col(code).alias("reference"),
                 F.col(valid).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("function_def"))
    eligible = has_eligible_line(F.col("code"), F.col("language"))
    cand = F.col("valid") & eligible if compat else F.col("valid") & (F.col("code") != "") & eligible
    return d.withColumn("candidate", cand)


def _corrupted(flagged: DataFrame, quota: DataFrame, groups: list[str], key: str, seed: int, compat: bool,
               recheck: bool, checkers: dict | None) -> DataFrame:
    """The chosen candidates with column ``corrupted``. Without ``recheck``
    the quota is taken first and only chosen rows are corrupted. With it, all
    candidates are corrupted and checked again, and the quota is taken among those
    that really broke, so it is filled as far as there are any."""
    candidates = flagged.where("candidate")
    if not recheck:
        return with_corruption(hash_quota(candidates, quota, groups, key, seed), "code", "language", key, "corrupted",
                               seed, compat)
    # written before the check: a filter on it would otherwise be pushed below the
    # staged corruption, inlining it (see corrupt.py)
    made = materialize(with_corruption(candidates, "code", "language", key, "corrupted", seed, compat))
    whole = whole_function(F.col("function_def"), F.col("corrupted"))
    checked = made.withColumn("_still_valid", valid_code(whole, F.col("language"), checkers))
    broken = materialize(checked.where(F.col("corrupted").isNotNull() & ~F.col("_still_valid")).drop("_still_valid"))
    return hash_quota(broken, quota, groups, key, seed)


def preference_counters(base: DataFrame, not_compile: float = 0.5, mode: str = "kto",
                        groups=("language",), key: str = "row_id", compat: bool = False,
                        **cols) -> DataFrame:
    """Per group: rows, non-empty completions, valid completions, natural
    negatives, corruption candidates and the quota."""
    groups = list(groups)
    flagged = label_predictions(base, key=key, groups=groups, compat=compat, **cols)
    counts = _quota_counts(flagged, groups)
    q = kto_quota(counts, not_compile) if mode == "kto" else dpo_quota(counts, not_compile, compat)
    return q.withColumnRenamed("k", "quota")
