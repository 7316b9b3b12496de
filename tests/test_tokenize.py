"""Model tokens against a plain merge loop."""

import base64
import re

import pytest
import regex
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from codepref.operators.tokenize import PATTERN, read_vocabulary, token_ids, token_length, token_text
from codepref.plans.q_tokens import VOCABULARY
from codepref.sources.tables import read_table

from tests.conftest import SF_SMALL

TEXTS = [None, "", " ", "  a\n\n b ", "don't we'll 12a3", "façade — naïve ¿qué? 漢字 🙂", "x" * 5000, "\t\tif (a) {\n}\r\n", "a b  c"]


def plain(text, ranks):
    out = []
    for piece in regex.findall(PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_ids_lengths_and_texts(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(VOCABULARY, "rb"))}
    v = read_vocabulary(spark, VOCABULARY)
    docs = [r["text"] for r in read_table(spark, SF_SMALL, "documents").select("text").limit(20).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + docs)], "i int, t string")
    got = df.select("t", token_ids(F.col("t"), v).alias("ids"), token_length(F.col("t"), v).alias("n")).collect()
    for r in got:
        want = None if r["t"] is None else plain(r["t"], ranks)
        assert r["ids"] == want and r["n"] == (None if want is None else len(want))
    back = df.select("t", token_text(token_ids(F.col("t"), v), v).alias("back")).collect()
    assert all(r["t"] == r["back"] for r in back)


def test_wrong_vocabularies(spark, tmp_path):
    few = tmp_path / "few.tiktoken"
    few.write_text("IQ== 0\nIg== 1\n")
    with pytest.raises(ValueError, match="byte-level"):
        read_vocabulary(spark, str(few))


def test_ids_leave_python_as_arrow(spark):
    """Ids are no lists of Python's numbers, and rows keep theirs across nulls and empty texts."""
    v = read_vocabulary(spark, VOCABULARY)
    many = ["word 1234 " * 50, None, "", None, "a"] * 40
    df = spark.createDataFrame(list(enumerate(many)), "i int, t string").coalesce(1)
    d = df.select("i", token_ids(F.col("t"), v).alias("ids"))
    kinds = re.findall(r"encode\(t#\d+\)#\S+?(\d+)|ArrowEvalPython \[[^\]]*\], \[[^\]]*\], (\d+)", d._jdf.queryExecution().executedPlan().toString())
    assert kinds and kinds[0][1] == str(PythonEvalType.SQL_SCALAR_ARROW_UDF)
    got = [r["ids"] for r in d.orderBy("i").collect()]
    assert got[:5] == got[5:10] == got[-5:] and [g is None for g in got[:5]] == [False, True, False, True, False] and got[2] == []
    none = df.where("i % 5 = 1").select(token_ids(F.col("t"), v).alias("ids")).collect()
    assert all(r["ids"] is None for r in none) and len(none) == 40
