"""Queries: schema unification (N1-N10) on the ``code_raw`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from codepref.operators import normalize as nz
from codepref.plans.catalog import register
from codepref.sources.fixtures import BROKEN_SQL, oracle_ctes, view

RAW = oracle_ctes("code_raw", "code_base")
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
# The patterns of N5 and N6, in RE2 form.
DOC_RE = r"(?s)/\*\*.*?\*/"
METHOD_RE2 = r"([\p{L}\p{N}_]+\s+[\p{L}\p{N}_]+\s*)\((.*?)\)"

JAVA_SQL = f"""
SELECT row_id,
  CASE WHEN instr(func_code_string, '{{') > 0 THEN {STRIP.format(x="split_part(func_code_string, '{', 1)")} END AS function_def,
  chr(9) || '* ' || replace(func_documentation_string, chr(10), chr(10) || chr(9) || '* ') AS documentation,
  {STRIP.format(x="split_part(func_code_string, '{', 1)")} || ' {{' || chr(10) || '    /**' || chr(10) || chr(9) || '* '
    || replace(func_documentation_string, chr(10), chr(10) || chr(9) || '* ') || chr(10) || '    */' AS prompt,
  CASE WHEN instr(func_code_string, '{{') > 0 THEN substr(func_code_string, instr(func_code_string, '{{') + 1) END
    AS code_completion
FROM code_raw WHERE language = 'java'
"""

KOTLIN_SQL = f"""
SELECT row_id,
  CASE WHEN regexp_extract(problem, '{DOC_RE}') <> ''
       THEN {STRIP.format(x=f"regexp_replace(problem, '{DOC_RE}', '', 'g')")} END AS function_def,
  CASE WHEN regexp_extract(problem, '{DOC_RE}') <> '' THEN regexp_extract(problem, '{DOC_RE}') END AS documentation,
  problem AS prompt, solution AS code_completion, problem || chr(10) || solution AS whole_func_string
FROM code_raw WHERE language = 'kotlin'
"""

# Python parts as the AST round trip writes them: comments are gone, literals are
# single-quoted, a one-line if is two lines, and inner docstrings are dropped
# (N4) or kept (N4b). Each 23rd function lacks its docstring: then an inner one is
# the first documented, and without that, or if the row doesn't parse, there are no parts.
def _py_sql(inner_doc: bool) -> str:
    q1 = "chr(39)"
    nl, nt = "chr(10)", "chr(10) || chr(9)"
    often = "repeat({nt} || 'if a:' || {nt} || '    pass', CASE WHEN row_id % 31 = 0 THEN 80 WHEN row_id % 25 = 0 THEN 7 ELSE 0 END)".format(nt=nt)
    text = f" || {nt} || '    ' || repeat(chr(34), 3) || 'Inner doc.' || repeat(chr(34), 3)" if inner_doc else ""
    bare, inner = (f"{nt} || 'def inner(x):'{t} || {nt} || '    return x'" for t in ("", text))
    each = lambda before, after: f"{nt} || {before} || replace(payload, {nl}, {after} || {nt} || {before}) || {after}"
    quoted = f"'use(' || {q1} || chr(34) || 'q' || chr(34) || ' '"
    forms = f"""CASE row_id % 4 WHEN 0 THEN ''
      WHEN 1 THEN {nt} || 't = [' || {q1} || replace(payload, {nl}, {q1} || ', ' || {q1}) || {q1} || ']'
      WHEN 2 THEN {each(quoted, f"{q1} || ')'")}
      ELSE {each(f"'if len(' || {q1}", f"{q1} || ') > a:' || {nt} || '    c = b'")} END"""
    body = f"""chr(9) || 'c = a + b' || CASE WHEN row_id % 7 = 0 THEN {nt} || 'c = a + b' ELSE '' END || {often}
      || CASE WHEN row_id % 6 <> 0 THEN '' WHEN row_id % 23 = 0 THEN {bare} ELSE {inner} END || {forms} || {nt} || 'return c'"""
    return f"""
SELECT row_id, function_def, documentation,
  function_def || '    \"\"\"' || chr(10) || documentation || chr(10) || '    \"\"\"' AS prompt, {body} AS code_completion
FROM (SELECT r.row_id, b.payload,
    CASE WHEN r.row_id % 23 = 0 THEN 'def inner(x):' ELSE b.function_def END || {nl} AS function_def,
    CASE WHEN r.row_id % 23 = 0 THEN chr(9) || 'Inner doc.' ELSE chr(9) || replace(b.documentation, {nl}, {nt}) END AS documentation
  FROM code_raw r JOIN code_base b USING (row_id)
  WHERE r.language = 'python' AND (r.row_id % 23 <> 0 OR r.row_id % 6 = 0) AND NOT {BROKEN_SQL.format('r.func_code_string')})
"""


PY_SQL, PY_OUTERMOST_SQL = _py_sql(False), _py_sql(True)


def _raw(spark, sf_dir):
    return view(spark, sf_dir, "code_raw")


@register("n02_java_parts", RAW + JAVA_SQL)
def n02_java_parts(spark, sf_dir):
    """Java def / documentation / prompt / body."""
    r = _raw(spark, sf_dir).where("language = 'java'")
    p = nz.java_parts(F.col("func_code_string"), F.col("func_documentation_string"))
    return r.select("row_id", p.alias("p")).select("row_id", "p.*")


@register("n05_kotlin_parts", RAW + KOTLIN_SQL)
def n05_kotlin_parts(spark, sf_dir):
    """N5 + N7: Kotlin exercise parts."""
    r = _raw(spark, sf_dir).where("language = 'kotlin'")
    return r.select("row_id", nz.kotlin_parts(F.col("problem"), F.col("solution")).alias("p")).select("row_id", "p.*")


@register("n06_kotlin_name", RAW + f"""
SELECT row_id, trim(replace(regexp_extract(d, '{METHOD_RE2}', 1), 'fun ', '')) AS func_name,
       replace(regexp_extract(problem, '{METHOD_RE2}', 1), 'fun ', '') AS func_name_compat
FROM (SELECT row_id, problem, {STRIP.format(x=f"regexp_replace(problem, '{DOC_RE}', '', 'g')")} AS d
      FROM code_raw WHERE language = 'kotlin')
""")
def n06_kotlin_name(spark, sf_dir):
    """Kotlin function name (on the def, and literal on the problem)."""
    r = _raw(spark, sf_dir).where("language = 'kotlin'")
    d = nz.py_strip(F.regexp_replace(F.col("problem"), nz.DOC_COMMENT, ""))
    return r.select("row_id", nz.kotlin_name(d).alias("func_name"),
                    nz.kotlin_name(F.col("problem"), compat=True).alias("func_name_compat"))


@register("n03_python_parts", RAW + PY_SQL)
def n03_python_parts(spark, sf_dir):
    """N3 + N4: Python parts through the stdlib AST (Arrow-batched UDF)."""
    r = _raw(spark, sf_dir).where("language = 'python'")
    p = nz.python_parts(F.col("func_code_string"))
    return (r.select("row_id", p.alias("p")).select("row_id", "p.*")
            .where(F.col("function_def").isNotNull()))


@register("n10_normalize", RAW + f"""
SELECT row_id, language, func_name, documentation, function_def, code_completion, prompt, whole_func_string FROM (
  SELECT j.row_id, 'java' AS language, r.func_name, j.documentation, j.function_def, j.code_completion, j.prompt,
         j.function_def || chr(10) || j.code_completion AS whole_func_string
  FROM ({JAVA_SQL}) j JOIN code_raw r USING (row_id)
  UNION ALL
  SELECT p.row_id, 'python', r.func_name, p.documentation, p.function_def, p.code_completion, p.prompt,
         p.function_def || chr(10) || p.code_completion
  FROM ({PY_SQL}) p JOIN code_raw r USING (row_id)
  UNION ALL
  SELECT row_id, 'kotlin', trim(replace(regexp_extract(function_def, '{METHOD_RE2}', 1), 'fun ', '')),
         documentation, function_def, code_completion, prompt, whole_func_string
  FROM ({KOTLIN_SQL}) k
) WHERE function_def IS NOT NULL AND code_completion IS NOT NULL
""")
def n10_normalize(spark, sf_dir):
    """N1 + N9 + N10 (+ N5-N7, F12): one unified seed table."""
    return nz.normalize_seed(_raw(spark, sf_dir)).select(*nz.UNIFIED_COLUMNS)


@register("n04b_outermost", RAW + PY_OUTERMOST_SQL)
def n04b_outermost(spark, sf_dir):
    """Drop only the outermost docstring on each branch (inner functions keep theirs)."""
    r = _raw(spark, sf_dir).where("language = 'python'")
    p = nz.python_parts(F.col("func_code_string"), docstrings="outermost")
    return (r.select("row_id", p.alias("p")).select("row_id", "p.*")
            .where(F.col("function_def").isNotNull()))
