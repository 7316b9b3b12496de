"""Queries: prediction handling, validity, corruption and preference rows
(N8, N11-N13, V1-V6, C2-C6, P1-P6) on the ``code_base`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from codepref.functions.text import extract_completion, prompt_found, remove_markers, whole_function
from codepref.operators.corrupt import has_eligible_line, with_corruption
from codepref.operators.normalize import java_parts
from codepref.operators.preference import (build_dpo, build_kto, flag_from_labels, kto_rows, label_predictions,
                                          preference_counters)
from codepref.operators.sampling import materialize
from codepref.operators.sanitize import sanitize
from codepref.operators.validity import balanced, failure_counts, lenient_verdict, python_compiles, structural, wrap_in_class
from codepref.plans.catalog import register
from codepref.plans.sql_parts import sql_balanced, sql_corrupt, sql_eligible, sql_extract, sql_hash, sql_remove_markers
from codepref.sources.fixtures import BROKEN_SQL, oracle_ctes, view
from codepref.sources.tables import read_table

SEED = 7

# ---------------------------------------------------------------- shared SQL
# Labelled base rows: extracted code, whole function, validity, candidate.
# SQL cannot parse Python; a Python body compiles exactly when it is not empty and
# shows none of the defects that the view plants (tests hold this against the real
# compile check, row by row, at two scale factors).
PY_VALID = f"(code <> '' AND NOT {BROKEN_SQL.format('code')})"
LABELLED = f"""
lab0 AS (SELECT row_id, language, prompt, function_def, code_completion AS reference,
                {sql_extract(sql_remove_markers('prediction'), 'prompt')} AS code FROM code_base),
lab1 AS (SELECT *, function_def || chr(10) || code AS whole FROM lab0),
lab AS (SELECT row_id, language, prompt, reference, code,
          CASE WHEN language = 'python' THEN {PY_VALID}
               ELSE {sql_balanced('whole', 'language')} END AS valid,
          {sql_eligible('code', 'language')} AS eligible FROM lab1),
flag AS (SELECT *, valid AND code <> '' AND eligible AS candidate FROM lab)
"""


def _with(*extra: str) -> str:
    return oracle_ctes("code_base").rstrip() + ",\n" + ",\n".join(x.strip() for x in extra) + "\n"


def _counts(quota_expr: str) -> str:
    return f"""
counts AS (SELECT language, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS neg,
             count(*) FILTER (WHERE candidate) AS candidates,
             count(*) FILTER (WHERE code <> '') AS nonempty,
             count(*) FILTER (WHERE valid) AS n_valid FROM flag GROUP BY language),
quota AS (SELECT *, {quota_expr} AS k FROM counts),
chosen AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY language
             ORDER BY {sql_hash('row_id', SEED)}, row_id) AS rn FROM flag WHERE candidate) f
           JOIN quota USING (language) WHERE rn <= k)
"""


KTO_K = "greatest(0, CAST(floor(n * CAST(0.5 AS DOUBLE) / (1 - CAST(0.5 AS DOUBLE))) AS BIGINT) - neg)"
DPO_K = "greatest(0, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) - neg)"


def _base(spark, sf_dir):
    return view(spark, sf_dir, "code_base")


# ------------------------------------------------------------------ queries
@register("p02_kto", _with(LABELLED, _counts(KTO_K)) + f"""
SELECT language, row_id, prompt, code AS completion, false AS label FROM flag WHERE NOT valid
UNION ALL
SELECT language, row_id, prompt, {sql_corrupt('code', 'language', 'row_id', SEED)} AS completion,
       false AS label FROM chosen
UNION ALL
SELECT language, row_id, prompt, reference AS completion, true AS label FROM flag
""")
def p02_kto(spark, sf_dir):
    """P2 (flagship): KTO rows with f = 0.5."""
    return build_kto(_base(spark, sf_dir), not_compile=0.5, seed=SEED)


@register("p01_dpo", _with(LABELLED, _counts(DPO_K)) + f"""
SELECT language, row_id, prompt, code AS rejected, reference AS chosen FROM flag WHERE NOT valid
UNION ALL
SELECT language, row_id, prompt, {sql_corrupt('code', 'language', 'row_id', SEED)} AS rejected,
       reference AS chosen FROM chosen
""")
def p01_dpo(spark, sf_dir):
    """DPO rows with f = 0.6."""
    return build_dpo(_base(spark, sf_dir), not_compile=0.6, seed=SEED)


@register("p06_counters", _with(LABELLED, _counts(KTO_K)) + """
SELECT language, n, neg, candidates, nonempty, n_valid, k AS quota FROM quota
""")
def p06_counters(spark, sf_dir):
    """Counters per language (KTO quota, f = 0.5)."""
    return preference_counters(_base(spark, sf_dir), 0.5, "kto").select(
        "language", "n", "neg", "candidates", "nonempty", "n_valid", "quota")


@register("n12_completion", _with(LABELLED) + """
SELECT row_id, language, code AS completion, instr(prediction, prompt) > 0 AS prompt_found
FROM lab0 JOIN code_base USING (row_id, language, prompt)
""")
def n12_completion(spark, sf_dir):
    """N11 + N12: completion extracted from the raw prediction."""
    b = _base(spark, sf_dir)
    return b.select("row_id", "language",
                    extract_completion(remove_markers(F.col("prediction")), F.col("prompt")).alias("completion"),
                    prompt_found(F.col("prediction"), F.col("prompt")).alias("prompt_found"))


@register("n12_conv_completion", oracle_ctes("conv_pairs") + f"""
SELECT conv_id, turn, {sql_extract('completion', 'prompt')} AS completion FROM conv_pairs
""")
def n12_conv_completion(spark, sf_dir):
    """N12 on real prompt / answer turns."""
    p = view(spark, sf_dir, "conv_pairs")
    return p.select("conv_id", "turn", extract_completion(F.col("completion"), F.col("prompt")).alias("completion"))


@register("n13_sanitise", _with(LABELLED) + """
SELECT b.row_id AS task_id, b.language, b.prompt, b.prediction AS original_prediction,
       b.prediction AS middle_prediction,
       CASE WHEN b.language = 'java' THEN l.code || chr(10) || '}' ELSE l.code END AS completion
FROM code_base b JOIN lab0 l USING (row_id)
""")
def n13_sanitise(spark, sf_dir):
    """Sanitised prediction table."""
    b = _base(spark, sf_dir).withColumnRenamed("row_id", "task_id")
    return sanitize(b, prediction="prediction", prompt="prompt").select(
        "task_id", "language", "prompt", "original_prediction", "middle_prediction", "completion")


@register("n08_whole", oracle_ctes("code_base", "code_raw") + r"""
SELECT b.row_id, b.function_def || chr(10) || b.code_completion AS whole_reference,
  CASE WHEN r.language = 'java' AND instr(r.func_code_string, '{') > 0
       THEN regexp_replace(split_part(r.func_code_string, '{', 1), '^\s+|\s+$', '', 'g') || ' {' || chr(10)
            || substr(r.func_code_string, instr(r.func_code_string, '{') + 1) END AS whole_repaired
FROM code_base b JOIN code_raw r USING (row_id)
""")
def n08_whole(spark, sf_dir):
    """Whole reference function; for Java rows rebuilt from the raw
    function string by N2, with the brace put back (Q3)."""
    b = _base(spark, sf_dir)
    r = view(spark, sf_dir, "code_raw")
    parts = java_parts(F.col("func_code_string"), F.col("func_documentation_string"))
    repaired = F.when(F.col("language") == "java", whole_function(
        parts["function_def"], parts["code_completion"], F.col("language"), repair_java_brace=True))
    return (b.join(r.select("row_id", "language", "func_code_string", "func_documentation_string"),
                   ["row_id", "language"])
            .select("row_id", whole_function(F.col("function_def"), F.col("code_completion")).alias("whole_reference"),
                    repaired.alias("whole_repaired")))


@register("v01_py_valid", _with(LABELLED) + """
SELECT row_id, valid FROM lab WHERE language = 'python'
""")
def v01_py_valid(spark, sf_dir):
    """V1: Python predictions that compile (Arrow-batched compile check)."""
    b = _base(spark, sf_dir).where("language = 'python'")
    code = extract_completion(remove_markers(F.col("prediction")), F.col("prompt"))
    return b.select("row_id", python_compiles(whole_function(F.col("function_def"), code)).alias("valid"))


@register("v02_balanced", oracle_ctes("code_base") + f"""
SELECT row_id, language, {sql_balanced("function_def || chr(10) || code_completion", 'language')} AS ref_ok,
       {sql_balanced('prediction', 'language')} AS pred_ok
FROM code_base
""")
def v02_balanced(spark, sf_dir):
    """V2: native structural check of references and raw predictions."""
    b = _base(spark, sf_dir)
    lang = F.col("language")
    return b.select("row_id", "language",
                    structural(whole_function(F.col("function_def"), F.col("code_completion")), lang).alias("ref_ok"),
                    structural(F.col("prediction"), lang).alias("pred_ok"))


@register("v03_wrap", oracle_ctes("code_base") + """
SELECT row_id, CASE WHEN language = 'java' THEN chr(10) || 'class Main {' || chr(10) || '    '
         || replace(w, chr(10), chr(10) || chr(9)) || chr(10) || '}' || chr(10) || '    '
       WHEN language = 'kotlin' THEN chr(10) || 'class Main {' || chr(10) || '    companion object {'
         || chr(10) || '        ' || replace(w, chr(10), chr(10) || chr(9) || chr(9)) || chr(10) || '    }'
         || chr(10) || '}' || chr(10) || '    '
       ELSE w END AS wrapped
FROM (SELECT row_id, language, function_def || chr(10) || code_completion AS w FROM code_base)
""")
def v03_wrap(spark, sf_dir):
    """V3: compiler wrappers around whole functions."""
    b = _base(spark, sf_dir)
    w = whole_function(F.col("function_def"), F.col("code_completion"))
    return b.select("row_id", wrap_in_class(w, F.col("language")).alias("wrapped"))


@register("v04_lenient", oracle_ctes("code_base") + """
SELECT row_id, NOT (broken OR calls) OR (calls AND NOT broken) AS valid
FROM (SELECT row_id, """ + BROKEN_SQL.format("prediction") + """ AS broken, contains(prediction, 'use(') AS calls FROM code_base)
""")
def v04_lenient(spark, sf_dir):
    """V4: lenient verdict over a compiler result table (exit code, output)
    derived per row from the view."""
    b = _base(spark, sf_dir)
    # what a compiler would say: a syntax error first, else an unknown function
    broken, calls = F.expr(BROKEN_SQL.format("prediction")), F.contains(F.col("prediction"), F.lit("use("))
    code = F.when(broken | calls, 1).otherwise(0)
    out = F.when(broken, F.lit("Main.java:2: error: ';' expected")).when(calls, F.lit("Main.java:3: error: cannot find symbol"))
    return b.select("row_id", lenient_verdict(code, out).alias("valid"))


@register("v06_fail_count", _with(LABELLED) + """
SELECT language, count(*) FILTER (WHERE NOT valid) AS n_invalid, count(*) AS n_rows FROM lab GROUP BY language
""")
def v06_fail_count(spark, sf_dir):
    """V5 + V6: dispatch by language, failures per language."""
    lab = label_predictions(_base(spark, sf_dir))
    return failure_counts(lab, "valid", "language")


@register("c03_corrupt", _with(LABELLED) + f"""
SELECT row_id, language, {sql_corrupt('code', 'language', 'row_id', SEED)} AS corrupted,
       eligible FROM lab WHERE valid
""")
def c03_corrupt(spark, sf_dir):
    """Corruption of every valid extracted completion."""
    lab = label_predictions(_base(spark, sf_dir)).where("valid")
    lab = lab.withColumn("eligible", has_eligible_line(F.col("code"), F.col("language")))
    return with_corruption(lab, seed=SEED).select("row_id", "language", "corrupted", "eligible")


@register("c04_corrupt_compat", _with(LABELLED) + f"""
SELECT row_id, language, {sql_corrupt('code', 'language', 'row_id', SEED, compat=True)} AS corrupted
FROM lab WHERE valid
""")
def c04_corrupt_compat(spark, sf_dir):
    """C4 compat: the edit hits the first substring occurrence of the token."""
    lab = label_predictions(_base(spark, sf_dir)).where("valid")
    return with_corruption(lab, seed=SEED, compat=True).select("row_id", "language", "corrupted")


# All languages by the bracket check; the quota is taken among corruptions that broke.
C6_SQL = _with(LABELLED.replace(f"CASE WHEN language = 'python' THEN {PY_VALID}\n               ELSE ", "CASE WHEN true THEN "), f"""
made AS (SELECT *, {sql_corrupt('code', 'language', 'row_id', SEED)} AS corrupted FROM flag JOIN (SELECT row_id, function_def FROM lab0) USING (row_id) WHERE candidate),
broken AS (SELECT * FROM (SELECT *, function_def || chr(10) || corrupted AS whole2 FROM made)
           WHERE corrupted IS NOT NULL AND NOT {sql_balanced('whole2', 'language')}),
counts AS (SELECT language, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS neg FROM flag GROUP BY language),
quota AS (SELECT *, {KTO_K} AS k FROM counts),
chosen AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {sql_hash('row_id', SEED)}, row_id) AS rn FROM broken) f
           JOIN quota USING (language) WHERE rn <= k)
""") + """
SELECT language, row_id, prompt, code AS completion, false AS label FROM flag WHERE NOT valid
UNION ALL SELECT language, row_id, prompt, corrupted AS completion, false AS label FROM chosen
UNION ALL SELECT language, row_id, prompt, reference AS completion, true AS label FROM flag
"""


@register("c06_recheck", C6_SQL)
def c06_recheck(spark, sf_dir):
    """KTO rows whose corrupted code is re-checked before the quota is taken,
    with native checkers for all languages (the compile check is under pytest)."""
    return build_kto(_base(spark, sf_dir), not_compile=0.5, seed=SEED, recheck=True,
                     checkers={"python": lambda c: balanced(c, "python")})


@register("p01_dpo_compat", _with(LABELLED.replace(
    "valid AND code <> '' AND eligible AS candidate", "valid AND eligible AS candidate"), _counts(
    "CASE WHEN CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) - neg >= 0 "
    "THEN CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) - neg "
    "ELSE greatest(0, candidates + CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) - neg) END")) + f"""
SELECT language, row_id, prompt, code AS rejected, reference AS chosen FROM flag WHERE NOT valid
UNION ALL
SELECT language, row_id, prompt, {sql_corrupt('code', 'language', 'row_id', SEED, compat=True)} AS rejected,
       reference AS chosen FROM chosen
""")
def p01_dpo_compat(spark, sf_dir):
    """P1 literal (Q5): f = 0.2 gives a negative quota, which the reference's
    slice turns into ``candidates + quota`` corrupted rows; C4 first-substring edits."""
    return build_dpo(_base(spark, sf_dir), not_compile=0.2, seed=SEED, compat=True)


LABEL_FLAG = f"""
lj AS (SELECT d.doc_id AS row_id, d.lang, 'python' AS language, substr(d.text, 1, 40) AS prompt,
              substr(d.text, 41) AS code, l.quality = 1 AND l.toxic = 0 AS valid
       FROM documents d JOIN labels l USING (doc_id)),
flag AS (SELECT *, code AS reference, valid AND code <> '' AND {sql_eligible('code', 'language')} AS candidate FROM lj),
counts AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS neg FROM flag GROUP BY lang),
quota AS (SELECT *, {KTO_K} AS k FROM counts),
chosen AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY lang
             ORDER BY {sql_hash('row_id', SEED)}, row_id) AS rn FROM flag WHERE candidate) f
           JOIN quota USING (lang) WHERE rn <= k)
"""


@register("p02_kto_labels", "WITH " + LABEL_FLAG.strip() + f"""
SELECT lang, language, row_id, prompt, code AS completion, false AS label FROM flag WHERE NOT valid
UNION ALL
SELECT lang, language, row_id, prompt, {sql_corrupt('code', 'language', 'row_id', SEED)} AS completion,
       false AS label FROM chosen
UNION ALL
SELECT lang, language, row_id, prompt, reference AS completion, true AS label FROM flag
""")
def p02_kto_labels(spark, sf_dir):
    """P2 with an external verdict: documents joined with labels (valid =
    quality 1 and not toxic); quota per document language (one language holds
    most rows); corruption with the Python rules on the prose."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "lang", F.lit("python").alias("language"),
        F.substr("text", F.lit(1), F.lit(40)).alias("prompt"), F.substr("text", F.lit(41)).alias("code"))
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("ok"))
    flagged = flag_from_labels(docs, labels, "row_id", "language", "ok", carry=["lang"])
    return kto_rows(materialize(flagged), 0.5, ["lang"], "row_id", SEED)
