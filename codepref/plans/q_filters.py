"""Queries: seed filters (F1-F13) and the rejected-rows anti join."""

from __future__ import annotations

from pyspark.sql import functions as F

from codepref.operators import filters as flt
from codepref.operators.sampling import materialize
from codepref.plans.catalog import register
from codepref.plans.sql_parts import sql_balanced
from codepref.sources.fixtures import BROKEN_SQL, oracle_ctes, view
from codepref.sources.tables import read_table

WHOLE = "(function_def || chr(10) || code_completion)"
LINES = f"string_split({WHOLE}, chr(10))"
# The patterns of F4 and N6, in RE2 form.
METHOD_RE2 = r"([\p{L}\p{N}_]+\s+[\p{L}\p{N}_]+\s*)\((.*?)\)"
BRANCH_RE2 = r"(if|else|for|while|case|catch)(\s*\(|\{)"
COMMENT_RE2 = r"//.*|/\*[\s\S]*?\*/"

S_F1 = "(length(documentation) > 60 AND length(documentation) < 2000)"
S_F2 = "((length(documentation) - length(replace(documentation, ' ', ''))) > 5)"
S_F3 = ("(NOT contains(lower(documentation), 'todo') AND NOT contains(lower(documentation), 'fixme') "
        "AND NOT contains(lower(documentation), 'tbd'))")
S_F4A = f"(len({LINES}) < 70)"
S_F4B = f"(len(regexp_extract_all({WHOLE}, '{BRANCH_RE2}')) < 6)"
S_MAXC = (f"list_max(list_transform(regexp_extract_all({WHOLE}, '{METHOD_RE2}', 2), "
          f"lambda p: len(regexp_extract_all(p, ','))))")
S_F4C = f"(coalesce({S_MAXC}, 0) < 8)"
S_RATIO = f"(len(regexp_extract_all(documentation, '{COMMENT_RE2}')) / len({LINES}))"
S_F4D = f"({S_RATIO} > 0.1 AND {S_RATIO} < 1)"
S_F4E = f"(len(list_distinct({LINES})) = len({LINES}))"
S_F4 = f"({S_F4A} AND {S_F4B} AND {S_F4C} AND {S_F4E})"
S_F4_COMPAT = (f"(CASE WHEN len(regexp_extract_all({WHOLE}, '{METHOD_RE2}', 2)) > 0 "
               f"THEN {S_F4A} AND {S_F4B} AND coalesce({S_MAXC}, 0) > 0 ELSE {S_F4D} AND {S_F4E} END)")
S_F6 = "(NOT contains(lower(documentation), lower(string_split(func_name, '.')[-1])))"
S_F6_COMPAT = "(NOT contains(lower(documentation), string_split(func_name, '.')[-1]))"
S_F7 = "(length(code_completion) + length(function_def) > 60 AND length(code_completion) + length(function_def) < 4000)"
S_F8 = f"(NOT contains(documentation, '\"\"\"\"') AND NOT contains({WHOLE}, '\"\"\"\" '))"
S_F9 = ("((contains(lower(documentation), 'return') AND (contains(lower(documentation), 'args') "
        "OR contains(lower(documentation), 'arguments') OR contains(lower(documentation), 'param'))) "
        "OR contains(lower(documentation), 'example::') OR contains(lower(documentation), ':param'))")
S_F10 = "(contains(lower(documentation), '@param') OR contains(lower(documentation), '@return'))"
S_LANG = (f"(CASE WHEN language = 'java' THEN {S_F10} AND {S_F6} WHEN language = 'python' "
          f"THEN {S_F9} AND {S_F8} AND {S_F6} ELSE true END)")
S_NATIVE = f"({S_LANG} AND {S_F7} AND {S_F1} AND {S_F2} AND {S_F3} AND {S_F4})"
# F5 on the seed: Python references compile unless they show the planted defect
# (held against the real compile check by the tests), the others are checked by
# the bracket balance.
S_VALID = f"(CASE WHEN language = 'python' THEN NOT {BROKEN_SQL.format('code_completion')} ELSE {sql_balanced(WHOLE, 'language')} END)"

SEED = oracle_ctes("code_seed")


def _seed(spark, sf_dir):
    return view(spark, sf_dir, "code_seed")


@register("f01_doc_size", """
SELECT doc_id, length(text) AS n_chars_cp FROM documents WHERE length(text) > 60 AND length(text) < 2000
""")
def f01_doc_size(spark, sf_dir):
    """F1 on the documents' text."""
    d = read_table(spark, sf_dir, "documents")
    return d.where(flt.doc_size("text")).select("doc_id", F.length("text").cast("bigint").alias("n_chars_cp"))


@register("f02_spaces", """
SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS n_spaces FROM documents
WHERE length(text) - length(replace(text, ' ', '')) > 5
""")
def f02_spaces(spark, sf_dir):
    """F2 on the documents' text."""
    d = read_table(spark, sf_dir, "documents")
    return d.where(flt.doc_spaces("text")).select(
        "doc_id", (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))).cast("bigint").alias("n_spaces"))


@register("f03_todo", SEED + f"SELECT row_id FROM code_seed WHERE {S_F3}")
def f03_todo(spark, sf_dir):
    """F3 on the seed documentation."""
    return _seed(spark, sf_dir).where(flt.no_todo()).select("row_id")


@register("f07_code_size", SEED + f"SELECT row_id FROM code_seed WHERE {S_F7}")
def f07_code_size(spark, sf_dir):
    """F7 on the seed."""
    return _seed(spark, sf_dir).where(flt.code_size()).select("row_id")


@register("f04_code_shape", SEED + f"""
SELECT row_id, len({LINES}) AS n_lines, len(regexp_extract_all({WHOLE}, '{BRANCH_RE2}')) AS n_branches,
       {S_MAXC} AS max_commas, {S_F4E} AS no_dups, {S_F4D} AS ratio_ok, {S_F4} AS keep
FROM code_seed
""")
def f04_code_shape(spark, sf_dir):
    """F4a-F4e and the documented combination."""
    s = _seed(spark, sf_dir)
    code = flt.whole_reference()
    return s.select("row_id", flt.code_lines(code).cast("bigint").alias("n_lines"),
                    flt.branch_count(code).cast("bigint").alias("n_branches"),
                    flt.max_param_commas(code).cast("bigint").alias("max_commas"), flt.no_duplicate_lines(code).alias("no_dups"),
                    flt.comment_ratio_ok(F.col("documentation"), code).alias("ratio_ok"),
                    flt.code_shape().alias("keep"))


@register("f04_compat", SEED + f"SELECT row_id, {S_F4_COMPAT} AS keep FROM code_seed")
def f04_compat(spark, sf_dir):
    """F4 as literally written (Q1)."""
    return _seed(spark, sf_dir).select("row_id", flt.code_shape(compat=True).alias("keep"))


@register("f06_name_mention", SEED + f"SELECT row_id, {S_F6} AS keep, {S_F6_COMPAT} AS keep_compat FROM code_seed")
def f06_name_mention(spark, sf_dir):
    """F6, documented and literal."""
    return _seed(spark, sf_dir).select("row_id", flt.no_name_mention().alias("keep"),
                                        flt.no_name_mention(compat=True).alias("keep_compat"))


@register("f08_quotes", SEED + f"SELECT row_id, {S_F8} AS keep FROM code_seed WHERE language = 'python'")
def f08_quotes(spark, sf_dir):
    """F8 (python rows)."""
    return _seed(spark, sf_dir).where("language = 'python'").select(
        "row_id", flt.python_quotes_ok().alias("keep"))


@register("f09_py_doc", SEED + f"SELECT row_id, {S_F9} AS keep FROM code_seed WHERE language = 'python'")
def f09_py_doc(spark, sf_dir):
    """F9 (python rows)."""
    return _seed(spark, sf_dir).where("language = 'python'").select("row_id", flt.python_doc_ok().alias("keep"))


@register("f10_java_doc", SEED + f"""
SELECT row_id, {S_F10} AS keep, true AS keep_compat FROM code_seed WHERE language = 'java'
""")
def f10_java_doc(spark, sf_dir):
    """F10 (java rows), documented and literal (Q2)."""
    return _seed(spark, sf_dir).where("language = 'java'").select(
        "row_id", flt.java_doc_ok().alias("keep"), flt.java_doc_ok(compat=True).alias("keep_compat"))


@register("f11_all_filters", SEED + f"""
SELECT row_id, language FROM code_seed WHERE function_def IS NOT NULL AND {S_NATIVE} AND {S_VALID}
""")
def f11_all_filters(spark, sf_dir):
    """F11 + F12 + F5: the filtered seed."""
    return flt.filter_seed(_seed(spark, sf_dir)).select("row_id", "language")


F13_SQL = SEED + f"""
SELECT language, count(*) AS n_rows, count(*) FILTER (WHERE {S_F1}) AS f01_doc_size,
  count(*) FILTER (WHERE {S_F2}) AS f02_spaces, count(*) FILTER (WHERE {S_F3}) AS f03_todo,
  count(*) FILTER (WHERE {S_F4}) AS f04_shape, count(*) FILTER (WHERE {S_F6}) AS f06_name,
  count(*) FILTER (WHERE {S_F7}) AS f07_code_size, count(*) FILTER (WHERE {S_LANG}) AS f_lang,
  count(*) FILTER (WHERE {S_NATIVE}) AS f_native
FROM code_seed GROUP BY language
"""


@register("f13_funnel", F13_SQL)
def f13_funnel(spark, sf_dir):
    """survivors per predicate per language in one aggregate."""
    return flt.funnel(_seed(spark, sf_dir))


@register("f13_observed", F13_SQL)
def f13_observed(spark, sf_dir):
    """F13 gathered while the filtered seed is written: no counting pass."""
    rows, found = flt.observed_funnel(_seed(spark, sf_dir))
    materialize(flt.filter_seed(rows).select("row_id", "language"))
    return flt.funnel_rows(spark, found)


@register("j01_rejected", SEED + f"""
SELECT row_id, language FROM code_seed s WHERE NOT EXISTS (
  SELECT 1 FROM code_seed k WHERE k.row_id = s.row_id AND k.function_def IS NOT NULL AND
    {S_NATIVE.replace('documentation', 'k.documentation')} AND {S_VALID})
""")
def j01_rejected(spark, sf_dir):
    """Rows the filters rejected (left anti join on row_id)."""
    s = _seed(spark, sf_dir)
    kept = flt.filter_seed(s)
    return flt.rejected_rows(s, kept).select("row_id", "language")


def _raw_seed_sql() -> str:
    from codepref.plans.q_normalize import JAVA_SQL, KOTLIN_SQL, METHOD_RE2 as M, PY_SQL, RAW

    seed = f"""
seed AS (
  SELECT j.row_id, 'java' AS language, r.func_name, j.documentation, j.function_def, j.code_completion
  FROM ({JAVA_SQL}) j JOIN code_raw r USING (row_id)
  UNION ALL
  SELECT p.row_id, 'python', r.func_name, p.documentation, p.function_def, p.code_completion
  FROM ({PY_SQL}) p JOIN code_raw r USING (row_id)
  UNION ALL
  SELECT row_id, 'kotlin', trim(replace(regexp_extract(function_def, '{M}', 1), 'fun ', '')),
         documentation, function_def, code_completion FROM ({KOTLIN_SQL}) k)
"""
    repaired = ("(CASE WHEN language = 'java' AND NOT ends_with(rtrim(function_def), '{') "
                "THEN function_def || ' {' ELSE function_def END || chr(10) || code_completion)")
    # normalised Python functions compile by construction (tab-indented unparsed bodies)
    valid = f"(CASE WHEN language = 'python' THEN true ELSE {sql_balanced(repaired, 'language')} END)"
    return (RAW.rstrip() + ",\n" + seed.strip() + "\n" +
            f"SELECT row_id, language FROM seed WHERE function_def IS NOT NULL AND code_completion IS NOT NULL "
            f"AND {S_NATIVE} AND {valid}")


@register("f11_from_raw", _raw_seed_sql())
def f11_from_raw(spark, sf_dir):
    """Seed filtering end to end: raw rows -> N1-N10 normalisation -> F1-F12 ->
    F5 validity (Java brace repaired, Q3)."""
    from codepref.operators.normalize import normalize_seed

    return flt.filter_seed(normalize_seed(view(spark, sf_dir, "code_raw"))).select("row_id", "language")


S_LANG_COMPAT = (f"(CASE WHEN language = 'java' THEN {S_F6_COMPAT} WHEN language = 'python' "
                 f"THEN {S_F9} AND {S_F8} AND {S_F6_COMPAT} ELSE true END)")
S_NATIVE_COMPAT = f"({S_LANG_COMPAT} AND {S_F7} AND {S_F1} AND {S_F2} AND {S_F3} AND {S_F4_COMPAT})"


@register("f11_compat", SEED + f"""
SELECT row_id, language FROM code_seed WHERE function_def IS NOT NULL AND {S_NATIVE_COMPAT} AND {S_VALID}
""")
def f11_compat(spark, sf_dir):
    """F11 as literally written: F4 (Q1), case-sensitive F6, F10 always true (Q2)."""
    return flt.filter_seed(_seed(spark, sf_dir), compat=True).select("row_id", "language")


J01_SQL = SEED + f"""
SELECT row_id, language FROM code_seed s WHERE NOT EXISTS (
  SELECT 1 FROM code_seed k WHERE k.row_id = s.row_id AND k.function_def IS NOT NULL AND
    {S_NATIVE.replace('documentation', 'k.documentation')} AND {S_VALID})
"""


@register("j01_rejected_pred", J01_SQL)
def j01_rejected_pred(spark, sf_dir):
    """J1 as a negated predicate: the same rows as ``j01_rejected`` without
    the anti join (no shuffle)."""
    return flt.rejected_seed(_seed(spark, sf_dir)).select("row_id", "language")
