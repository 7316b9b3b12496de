"""Column functions for text work: ``(Column, ...) -> Column``.

Everything here is a built-in Spark expression (JVM side, whole-stage codegen
where Spark supports it); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.splitlines`` break set, as a Java regex.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# The two sequence-marker strings removed from raw predictions.
SEQUENCE_MARKERS = ("<｜begin▁of▁sentence｜>", "<｜end▁of▁sentence｜>")

WORD_CHARS = "\\p{L}\\p{N}_"


def col(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def split_lines(text: Column) -> Column:
    """Python ``splitlines`` up to trailing empty items."""
    return F.split(text, LINE_BREAKS)


def py_strip(text: Column) -> Column:
    """Python ``str.strip()``: all Unicode whitespace on both ends (``trim``
    removes spaces only)."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def count_substr(text: Column, sub: str) -> Column:
    """Non-overlapping occurrences of a literal ``sub`` (``str.count``)."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(sub), F.lit("")))) / len(sub))


def remove_markers(text: Column, markers=SEQUENCE_MARKERS) -> Column:
    """Drop the sequence-marker strings."""
    for m in markers:
        text = F.replace(text, F.lit(m), F.lit(""))
    return text


def seeded_hash(key: Column | str, seed: int | str, step: int | None = None) -> Column:
    """R2: first 32 bits of md5("key:seed[:step]") as a non-negative bigint.

    Portable: DuckDB computes the same value, so hash-driven choices (quota,
    splits, corruption positions) have an exact SQL oracle."""
    parts = [col(key).cast("string"), F.lit(f":{seed}")]
    if step is not None:
        parts.append(F.lit(f":{step}"))
    return F.conv(F.substr(F.md5(F.concat(*parts)), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def sql_hash(key_sql: str, seed: int | str, step: int | None = None) -> str:
    """DuckDB text of :func:`seeded_hash` for oracles."""
    tail = f":{seed}" + (f":{step}" if step is not None else "")
    return f"CAST(('0x' || substr(md5(concat(CAST({key_sql} AS VARCHAR), '{tail}')), 1, 8)) AS BIGINT)"


def extract_completion(output: Column, prompt: Column) -> Column:
    """N12 (recipe R1): the function body the model wrote after the prompt.

    Cut after the first occurrence of the prompt (absent: from 0-based index
    ``len(prompt)-1``), split into lines, skip empty lines, stop at the first
    line that is not indented (kept only if it is exactly ``}``), join by
    ``\\n``. Lambda-free (Spark's common-subexpression elimination shares the
    pieces) and free of repeated regex groups (Java's regex engine recurses
    once per repetition, which overflows the stack on long outputs): one
    ``regexp_instr`` finds the first unindented line."""
    at = F.instr(output, prompt)
    start = F.when(at > 0, at + F.length(prompt)).otherwise(F.length(prompt))
    rest = F.substr(output, start)
    joined = F.array_join(F.array_remove(split_lines(rest), ""), "\n")
    # where the first unindented line starts in `joined` (a virtual "\n" in front)
    p = F.regexp_instr(F.concat(F.lit("\n"), joined), F.lit("\n[^ \t]"))
    kept = F.when(p > 2, F.substr(joined, F.lit(1), p - 2))
    stop_line = F.substring_index(F.substr(joined, p), "\n", 1)
    closing = F.when(stop_line == "}", F.lit("}"))
    return F.when(p == 0, joined).otherwise(F.concat_ws("\n", kept, closing))


def prompt_found(output: Column, prompt: Column) -> Column:
    """Q7 companion flag: did the output repeat the prompt?"""
    return F.instr(output, prompt) > 0


def whole_function(function_def: Column, body: Column, language: Column | None = None,
                   repair_java_brace: bool = False) -> Column:
    """``def + "\\n" + body``. With ``repair_java_brace`` a Java def that
    lost its ``{`` (Q3) gets `` {`` back so the whole function can compile."""
    d = function_def
    if repair_java_brace and language is not None:
        d = F.when((language == "java") & ~F.rtrim(d).endswith("{"),
                   F.concat(d, F.lit(" {"))).otherwise(d)
    return F.concat(d, F.lit("\n"), body)


def tokens(line: Column) -> Column:
    """C2 tokenizer ``\\w+|\\S`` with a Unicode word class."""
    return F.regexp_extract_all(line, F.lit(f"[{WORD_CHARS}]+|\\S"), 0)
