"""Validity flag (V1-V6).

* V1 Python: the code compiles with the stdlib ``compile``. This is the only
  check that needs Python, so it is a scalar pandas UDF: one Arrow column in,
  one boolean column out, and only Python rows are sent (others pass NULL).
* V2 Java / Kotlin: a native structural check, see ``structure``. ``balanced`` is the
  brackets alone: strings and comments are removed by one regex, the brackets are
  folded with ``aggregate`` over a string stack. No subprocess, no Python.
* V3 class wrappers, V4 lenient verdict, V6 failure counts are projections
  and one aggregate.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepref.operators.structure import well_formed

LANGUAGES = ("java", "python", "kotlin")

# String / comment syntax removed before bracket matching (RE2 form,
# used by the SQL oracle). String literals are written unrolled,
# "[^"\\\n]*(?:\\.[^"\\\n]*)*", which is deterministic: no alternative can backtrack.
C_LIKE_NOISE = (r'(?s)""".*?"""|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|' r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'|"
                r"/\*.*?\*/|//[^\n]*")
PYTHON_NOISE = (r'(?s)""".*?"""|' r"'''.*?'''|" r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'
                r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'|#[^\n]*")


# The same patterns for Spark, with possessive string loops: Java's regex
# engine recurses once per repetition of a group, a possessive loop does not
# (and cannot backtrack), so a literal with any number of escapes cannot
# overflow the stack. Matches are the same since the loops are deterministic.
C_LIKE_NOISE_JAVA = (r'(?s)""".*?"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'
                     r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|/\*.*?\*/|//[^\n]*")
PYTHON_NOISE_JAVA = (r'(?s)""".*?"""|' r"'''.*?'''|" r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'
                     r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|#[^\n]*")
BRACKETS = r"[(){}\[\]]"


def _fold_brackets(stripped: Column) -> Column:
    br = F.regexp_extract_all(stripped, F.lit(BRACKETS), 0)

    def step(acc, x):
        opener = F.when(x == ")", "(").when(x == "]", "[").otherwise("{")
        return (F.when(acc == "!", F.lit("!"))
                .when(x.isin("(", "[", "{"), F.concat(x, acc))
                .when(F.substr(acc, F.lit(1), F.lit(1)) == opener, F.substr(acc, F.lit(2)))
                .otherwise(F.lit("!")))

    return F.aggregate(br, F.lit(""), step) == ""


def balanced(code: Column, language: Column | str = "java") -> Column:
    """Brackets balanced and never closed before opened, ignoring strings and
    comments. ``language`` picks the comment syntax. :func:`structural` is the whole V2."""
    lang = F.lit(language) if isinstance(language, str) else language
    stripped = F.when(lang == "python", F.regexp_replace(code, PYTHON_NOISE_JAVA, "")) \
                .otherwise(F.regexp_replace(code, C_LIKE_NOISE_JAVA, ""))
    return _fold_brackets(stripped)


def structural(code: Column, language: Column) -> Column:
    """V2: Java and Kotlin code is well formed; of Python only the brackets are checked."""
    expr = F.when(language == "python", balanced(code, "python"))
    for lang in ("java", "kotlin"):
        expr = expr.when(language == lang, well_formed(code, lang))
    return expr


def _compile_reason(src):
    if src is None:
        return None
    try:
        compile(src, "<string>", "exec", dont_inherit=True)
        return ""
    except (SyntaxError, ValueError) as e:  # what the reference counts as "does not compile"
        return f"{type(e).__name__}: {e}"
    except (RecursionError, MemoryError, OverflowError) as e:  # escaped in the reference
        return f"{type(e).__name__}"


def _compile_errors(code: pd.Series) -> pd.Series:
    """V1 kernel: '' when the code compiles, else the error; NULL stays NULL."""
    return code.map(_compile_reason)


# Marked nondeterministic on purpose: it is an opaque, costly checker, and the
# flag keeps the optimizer from pushing it below staged projections (which
# would inline their expressions into its argument) or evaluating it twice.
python_compile_error = F.pandas_udf(_compile_errors, T.StringType()).asNondeterministic()


def python_compiles(code: Column) -> Column:
    """V1: the Python code compiles."""
    return python_compile_error(code) == ""


def valid_code(code: Column, language: Column, checkers: dict | None = None) -> Column:
    """V5 dispatch: language -> checker. Only Python rows reach the Python
    worker (others are sent as NULL). ``checkers`` may override any language
    with a Column function ``code -> boolean``; an unknown language is an error."""
    checkers = dict(checkers or {})
    py = checkers.pop("python", None)
    py_flag = py(code) if py else python_compiles(F.when(language == "python", code))
    expr = F.when(language == "python", py_flag)
    for lang in ("java", "kotlin"):
        fn = checkers.pop(lang, None)
        expr = expr.when(language == lang, fn(code) if fn else well_formed(code, lang))
    for lang, fn in checkers.items():
        expr = expr.when(language == lang, fn(code))
    return expr.otherwise(F.raise_error(F.concat(F.lit("language not supported: "), language)))


def wrap_in_class(code: Column, language: Column) -> Column:
    """V3: the wrapper a compiler needs: ``class Main { ... }`` for Java and
    ``class Main { companion object { ... } }`` for Kotlin, body re-indented."""
    java = F.concat(F.lit("\nclass Main {\n    "), F.replace(code, F.lit("\n"), F.lit("\n\t")),
                    F.lit("\n}\n    "))
    kotlin = F.concat(F.lit("\nclass Main {\n    companion object {\n        "),
                      F.replace(code, F.lit("\n"), F.lit("\n\t\t")), F.lit("\n    }\n}\n    "))
    return F.when(language == "java", java).when(language == "kotlin", kotlin).otherwise(code)


def lenient_verdict(exit_code: Column, output: Column) -> Column:
    """V4: a compiler result counts as valid when it exits 0 or only fails on
    unresolved symbols (message contains "error: cannot find symbol")."""
    return (exit_code == 0) | F.coalesce(output.contains("error: cannot find symbol"), F.lit(False))


def failure_counts(df: DataFrame, valid_col: str = "valid", by: str = "language") -> DataFrame:
    """V6: rows that fail the check, per language (one aggregate with map-side combine)."""
    return df.groupBy(by).agg(
        F.count_if(~F.col(valid_col)).alias("n_invalid"),
        F.count(F.lit(1)).alias("n_rows"))
