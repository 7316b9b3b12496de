"""Seed filters (F1-F13) as boolean Column functions over the unified seed
schema, plus the combined filter and the funnel report.

All predicates are native expressions, so Catalyst evaluates them in the scan
stage; the validity flag (F5), the only one that may need Python, is applied
last and only to rows that passed every native predicate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codepref.functions.text import WORD_CHARS, count_substr, whole_function
from codepref.operators.validity import LANGUAGES, valid_code

# Patterns and bounds of the reference filters.
BRANCH = r"(if|else|for|while|case|catch)(?=\s*\(|\{)"
METHOD = f"(?d)([{WORD_CHARS}]+\\s+[{WORD_CHARS}]+\\s*)\\((.*?)\\)"
COMMENT = r"(?d)//.*|/\*[\s\S]*?\*/"
TODO_WORDS = ("todo", "fixme", "tbd")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whole_reference(df_cols=("function_def", "code_completion")) -> Column:
    return F.concat(F.col(df_cols[0]), F.lit("\n"), F.col(df_cols[1]))


def doc_size(doc="documentation", lo: int = 60, hi: int = 2000) -> Column:
    """lo < len(doc) < hi (code points)."""
    n = F.length(_c(doc))
    return (n > lo) & (n < hi)


def doc_spaces(doc="documentation", min_spaces: int = 5) -> Column:
    """more than ``min_spaces`` spaces."""
    return count_substr(_c(doc), " ") > min_spaces


def no_todo(doc="documentation") -> Column:
    """lower(doc) holds none of todo / fixme / tbd."""
    low = F.lower(_c(doc))
    out = F.lit(True)
    for w in TODO_WORDS:
        out = out & ~low.contains(w)
    return out


def code_lines(code: Column) -> Column:
    return F.size(F.split(code, "\n"))


def few_lines(code: Column, max_lines: int = 70) -> Column:
    """F4a."""
    return code_lines(code) < max_lines


def branch_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(BRANCH))


def few_branches(code: Column, max_branches: int = 6) -> Column:
    """F4b."""
    return branch_count(code) < max_branches


def max_param_commas(code: Column) -> Column:
    """Largest comma count over all ``word word(...)`` parameter lists (NULL if none)."""
    params = F.regexp_extract_all(code, F.lit(METHOD), 2)
    return F.array_max(F.transform(params, lambda p: F.regexp_count(p, F.lit(","))))


def few_params(code: Column, max_commas: int = 8) -> Column:
    """F4c (documented intent): every parameter list has fewer than 8 commas."""
    return F.coalesce(max_param_commas(code), F.lit(0)) < max_commas


def comment_ratio(doc: Column, code: Column) -> Column:
    return F.regexp_count(doc, F.lit(COMMENT)) / code_lines(code)


def comment_ratio_ok(doc: Column, code: Column) -> Column:
    """F4d: 0.1 < comments(doc) / lines(code) < 1."""
    r = comment_ratio(doc, code)
    return (r > 0.1) & (r < 1)


def no_duplicate_lines(code: Column) -> Column:
    """F4e."""
    ls = F.split(code, "\n")
    return F.size(F.array_distinct(ls)) == F.size(ls)


def code_shape(doc="documentation", code: Column | None = None, compat: bool = False,
               with_comment_ratio: bool = False) -> Column:
    """F4. Default: F4a and F4b and F4c and F4e (+ F4d on request).
    ``compat=True``: the literal reading of the reference (Q1): with a method
    match, lines, branches and *some* comma; without one, F4d and F4e only."""
    code = whole_reference() if code is None else code
    doc = _c(doc)
    if compat:
        has_method = F.size(F.regexp_extract_all(code, F.lit(METHOD), 2)) > 0
        return (F.when(has_method, few_lines(code) & few_branches(code)
                       & (F.coalesce(max_param_commas(code), F.lit(0)) > 0))
                .otherwise(comment_ratio_ok(doc, code) & no_duplicate_lines(code)))
    out = few_lines(code) & few_branches(code) & few_params(code) & no_duplicate_lines(code)
    return out & comment_ratio_ok(doc, code) if with_comment_ratio else out


def no_name_mention(doc="documentation", func_name="func_name", compat: bool = False) -> Column:
    """the last dotted part of the function name is not in lower(doc).
    ``compat`` keeps the name's case (a mixed-case name never matches)."""
    name = F.element_at(F.split(_c(func_name), "[.]"), -1)
    if not compat:
        name = F.lower(name)
    return ~F.lower(_c(doc)).contains(name)


def code_size(lo: int = 60, hi: int = 4000, code="code_completion", fdef="function_def") -> Column:
    """lo < len(completion) + len(def) < hi."""
    n = F.length(_c(code)) + F.length(_c(fdef))
    return (n > lo) & (n < hi)


def python_quotes_ok(doc="documentation", code: Column | None = None) -> Column:
    """F8: no four double quotes in the doc, no four quotes + space in the code."""
    code = whole_reference() if code is None else code
    return ~_c(doc).contains('""""') & ~code.contains('"""" ')


def python_doc_ok(doc="documentation") -> Column:
    """("return" and args/arguments/param) or "example::" or ":param"."""
    d = F.lower(_c(doc))
    return ((d.contains("return") & (d.contains("args") | d.contains("arguments") | d.contains("param")))
            | d.contains("example::") | d.contains(":param"))


def java_doc_ok(doc="documentation", compat: bool = False) -> Column:
    """@param or @return in lower(doc); ``compat``: always true (Q2)."""
    if compat:
        return F.lit(True)
    d = F.lower(_c(doc))
    return d.contains("@param") | d.contains("@return")


def language_specific(compat: bool = False) -> Column:
    lang = F.col("language")
    return (F.when(lang == "java", java_doc_ok(compat=compat) & no_name_mention(compat=compat))
            .when(lang == "python", python_doc_ok() & python_quotes_ok() & no_name_mention(compat=compat))
            .when(lang == "kotlin", F.lit(True))
            .otherwise(F.raise_error(F.concat(F.lit("language not supported: "), lang))))


def native_filters(compat: bool = False, with_comment_ratio: bool = False) -> Column:
    """F11 without F5: language-specific part, then F7, F1, F2, F3, F4 (+ F4d on request)."""
    return (language_specific(compat) & code_size() & doc_size() & doc_spaces() & no_todo()
            & code_shape(compat=compat, with_comment_ratio=with_comment_ratio))


def filter_seed(df: DataFrame, compat: bool = False, check_validity: bool = True,
                checkers: dict | None = None, with_comment_ratio: bool = False) -> DataFrame:
    """F11 + F12: rows of the unified seed that pass every filter. Native
    predicates first; the validity check (F5) runs only on their survivors."""
    out = df.where(F.col("function_def").isNotNull() & native_filters(compat, with_comment_ratio))
    if check_validity:
        # Q3: the Java def lost its "{" in N2; it is put back for the check
        whole = whole_function(F.col("function_def"), F.col("code_completion"), F.col("language"),
                               repair_java_brace=not compat)
        out = out.where(valid_code(whole, F.col("language"), checkers))
    return out


def rejected_seed(df: DataFrame, compat: bool = False, checkers: dict | None = None,
                  with_comment_ratio: bool = False) -> DataFrame:
    """J1 when the kept rows are a filter of the same table: the rows
    ``filter_seed`` drops, found by the negated predicate. No anti join, so no
    shuffle of the text; the checker sees only rows that pass the native
    filters (others send NULL)."""
    native = F.coalesce(F.col("function_def").isNotNull() & native_filters(compat, with_comment_ratio), F.lit(False))
    whole = whole_function(F.col("function_def"), F.col("code_completion"), F.col("language"),
                           repair_java_brace=not compat)
    d = df.withColumn("_native", native)
    d = d.withColumn("_valid", valid_code(F.when(F.col("_native"), whole), F.col("language"), checkers))
    return (d.where(~F.col("_native") | ~F.coalesce(F.col("_valid"), F.lit(False)))
            .drop("_native", "_valid"))


def rejected_rows(df: DataFrame, kept: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``kept`` (left anti join)."""
    return df.join(kept.select(key), key, "left_anti")


def _stages(compat: bool) -> dict[str, Column]:
    return {
        "n_rows": F.lit(True),
        "f01_doc_size": doc_size(),
        "f02_spaces": doc_spaces(),
        "f03_todo": no_todo(),
        "f04_shape": code_shape(compat=compat),
        "f06_name": no_name_mention(compat=compat),
        "f07_code_size": code_size(),
        "f_lang": language_specific(compat),
        "f_native": native_filters(compat),
    }


def funnel(df: DataFrame, compat: bool = False, by: str = "language") -> DataFrame:
    """survivors per predicate and overall, per language, in one pass."""
    return df.groupBy(by).agg(*[F.count_if(p).alias(k) for k, p in _stages(compat).items()])


def observed_funnel(df: DataFrame, compat: bool = False, languages=LANGUAGES) -> tuple[DataFrame, Observation]:
    """F13 without a counting pass: ``df`` unchanged, with metrics that Spark gathers while
    an action reads it (a filtered write, say), and their observation."""
    found = Observation()
    stages = _stages(compat)
    # the predicates once, in generated code; the metrics only look at their bits
    passed = reduce(Column.bitwiseOR, [F.when(p, 1 << i).otherwise(0) for i, p in enumerate(stages.values())])
    metrics = [F.count_if((F.col("language") == lang) & (F.col("_passed").bitwiseAND(F.lit(1 << i)) != 0)).alias(f"{lang}.{k}")
               for lang in languages for i, k in enumerate(stages)]
    return df.withColumn("_passed", passed).observe(found, *metrics).drop("_passed"), found


def funnel_rows(spark: SparkSession, found: Observation) -> DataFrame:
    """The counters of :func:`observed_funnel` after an action, as :func:`funnel` gives them
    (waits for the action; languages without rows are left out)."""
    rows: dict[str, dict] = {}
    for name, n in found.get.items():
        language, stage = name.split(".")
        rows.setdefault(language, {})[stage] = n
    names = list(_stages(False))
    schema = "language string, " + ", ".join(f"{k} bigint" for k in names)
    return spark.createDataFrame([(lang, *[r[k] for k in names]) for lang, r in sorted(rows.items()) if r["n_rows"]], schema)
