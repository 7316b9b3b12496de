"""Randomised checks against small brute-force models of the documented
semantics (many cases per Spark job)."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codepref.functions.text import extract_completion, seeded_hash
from codepref.operators.validity import C_LIKE_NOISE, balanced

ALPHABET = st.sampled_from(list("ab P}{( )\t\n") + ["\r\n", "\r", "\x0b", "\x85", " ", "é", "  ", "}"])
TEXT = st.lists(ALPHABET, max_size=30).map("".join)


def model_extract(output: str, prompt: str) -> str:
    """N12 as documented: cut after the prompt (absent: at len(prompt)-1),
    non-empty lines while indented, plus a closing ``}`` line."""
    cut = output.find(prompt)
    start = cut + len(prompt) if cut >= 0 else len(prompt) - 1
    kept = []
    for line in output[start:].splitlines():
        if not line:
            continue
        if line[0] in " \t":
            kept.append(line)
            continue
        if line == "}":
            kept.append(line)
        break
    return "\n".join(kept)


SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(TEXT, st.sampled_from(["P", "a", "P\n", "", "zz"])), min_size=50, max_size=120))
def test_extraction_matches_model(spark, cases):
    df = spark.createDataFrame(cases, "o string, p string")
    got = [r["c"] for r in df.select(extract_completion(F.col("o"), F.col("p")).alias("c")).collect()]
    assert got == [model_extract(o, p) for o, p in cases]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(0, 99)), min_size=20, max_size=60))
def test_seeded_hash_matches_md5(spark, cases):
    df = spark.createDataFrame(cases, "k long, s int")
    got = [r["h"] for r in df.select(seeded_hash(F.col("k"), 7, 3).alias("h")).collect()]
    want = [int(hashlib.md5(f"{k}:7:3".encode()).hexdigest()[:8], 16) for k, _ in cases]
    assert got == want


def model_balanced(code: str) -> bool:
    stack = []
    for ch in re.findall(r"[(){}\[\]]", re.sub(C_LIKE_NOISE, "", code)):
        if ch in "([{":
            stack.append(ch)
        elif not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[ch]:
            return False
    return not stack


BRACKETS = st.lists(st.sampled_from(list("(){}[]x ") + ['"(', ')"', "//(\n", "/*)*/"]), max_size=20).map("".join)


@SETTINGS
@given(st.lists(BRACKETS, min_size=50, max_size=120))
def test_balanced_matches_stack_model(spark, cases):
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = [r["b"] for r in df.select(balanced(F.col("c"), "java").alias("b")).collect()]
    assert got == [model_balanced(c) for c in cases]
