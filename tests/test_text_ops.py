"""Golden rows for the text operators (expected values written by hand from
the semantics, not produced by the code under test)."""

import pytest
from pyspark.sql import functions as F

from codepref.functions.text import extract_completion, py_strip, split_lines, tokens
from codepref.operators.normalize import java_parts, kotlin_name, kotlin_parts, python_parts
from codepref.operators.validity import balanced, python_compiles

EXTRACTION = [
    # (output, prompt, expected)
    ("def f():\n    x = 1\n    return x\nprint(f())", "def f():", "    x = 1\n    return x"),
    ("P\n    a\n}\n}\nmore", "P", "    a\n}"),
    ("xyzP\n\tbody\n\n\tmore\nstop", "P", "\tbody\n\tmore"),
    ("a\n    rest", "zz", "    rest"),                 # prompt absent: cut at len(prompt)-1 = 1
    ("abcdef\n    rest", "zz", ""),                    # ... which leaves "bcdef" unindented
    ("P  tail on prompt line\n    b\nx", "P", "  tail on prompt line\n    b"),
    ("", "P", ""),
    ("P\nunindented\n    body", "P", ""),
    ("P\r\n    a\r\n    b\rX", "P", "    a\n    b"),
    ("P\n    only", "P", "    only"),
    ("P\n}}\n", "P", ""),
]


@pytest.mark.parametrize("output,prompt,expected", EXTRACTION)
def test_extract_completion(spark, output, prompt, expected):
    df = spark.createDataFrame([(output, prompt)], "o string, p string")
    got = df.select(extract_completion(F.col("o"), F.col("p")).alias("c")).first()["c"]
    assert got == expected


def test_line_breaks_match_python_splitlines(spark):
    text = "a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l m"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(split_lines(F.col("t")).alias("ls")).first()["ls"]
    assert [x for x in got if x] == text.splitlines()


def test_py_strip(spark):
    df = spark.createDataFrame([(" \t x y \n　",)], "t string")
    assert df.select(py_strip(F.col("t")).alias("s")).first()["s"] == "x y"


def test_tokens(spark):
    df = spark.createDataFrame([("if(façade_1 >= b) {",)], "t string")
    assert df.select(tokens(F.col("t")).alias("k")).first()["k"] == ["if", "(", "façade_1", ">", "=", "b", ")", "{"]


BALANCE = [
    ('int f() { return "}"; }', "java", True),
    ("int f() { // }\n}", "java", True),
    ("int f() { /* ) */ }", "java", True),
    ('def f():\n    """ ( """\n    return 1', "python", True),
    ("f([)]", "java", False),
    (")(", "java", False),
    ('x = "a\\"(" + (b)', "java", True),
    ("", "java", True),
    ("{ (", "kotlin", False),
    ("# ( \nx = (1)", "python", True),
]


@pytest.mark.parametrize("code,lang,expected", BALANCE)
def test_balanced(spark, code, lang, expected):
    df = spark.createDataFrame([(code, lang)], "c string, l string")
    assert df.select(balanced(F.col("c"), F.col("l")).alias("b")).first()["b"] is expected


def test_python_compiles(spark):
    df = spark.createDataFrame([("def f(a):\n    return a",), ("def f(:\n",), ("return 1",), (None,)], "c string")
    got = [r["v"] for r in df.select(python_compiles(F.col("c")).alias("v")).collect()]
    assert got == [True, False, False, None]


def test_java_parts(spark):
    df = spark.createDataFrame([("public int f(int a) {\n    return a;\n}", "Adds.\nMore."),
                                ("abstract void g();", "No body.")], "c string, d string")
    out = df.select(java_parts(F.col("c"), F.col("d")).alias("p")).select("p.*").collect()
    assert out[0]["function_def"] == "public int f(int a)"
    assert out[0]["documentation"] == "\t* Adds.\n\t* More."
    assert out[0]["prompt"] == "public int f(int a) {\n    /**\n\t* Adds.\n\t* More.\n    */"
    assert out[0]["code_completion"] == "\n    return a;\n}"
    assert out[1]["function_def"] is None and out[1]["code_completion"] is None


def test_kotlin_parts_and_name(spark):
    df = spark.createDataFrame([
        ("/** Doc one */\n/** two */\nfun sum(a: Int, b: Int): Int {", "    return a + b\n}"),
        ("fun nodoc(a: Int) {", "}"),
        ("/** d */ val x = 1", "")], "p string, s string")
    out = df.select(kotlin_parts(F.col("p"), F.col("s")).alias("k")).select("k.*").collect()
    assert out[0]["documentation"] == "/** Doc one */"
    assert out[0]["function_def"] == "fun sum(a: Int, b: Int): Int {"
    assert out[0]["whole_func_string"] == "/** Doc one */\n/** two */\nfun sum(a: Int, b: Int): Int {\n    return a + b\n}"
    assert out[1]["function_def"] is None and out[1]["documentation"] is None
    names = df.select(kotlin_name(F.col("p")).alias("n"), kotlin_name(F.col("p"), compat=True).alias("c")).collect()
    assert names[0]["n"] == "sum" and names[0]["c"] == "sum"
    assert names[2]["n"] == ""


PY_CASES = [
    ('def f(a, b=2, *args, c, **kw) -> int:\n    """Doc."""\n    return a\n',
     ("def f(a, b):\n", "\tDoc.", "\treturn a")),
    ('def outer(x):\n    """Outer."""\n    def inner():\n        """Inner."""\n        return 1\n    return inner()\n',
     ("def outer(x):\n", "\tOuter.", "\tdef inner():\n\t    return 1\n\treturn inner()")),
    ("def nodoc(a):\n    return a\n", None),
    ('async def g(a):\n    """Async doc."""\n    return a\n', None),
    ("def broken(:\n", None),
]


@pytest.mark.parametrize("src,expected", PY_CASES)
def test_python_parts(spark, src, expected):
    df = spark.createDataFrame([(src,)], "c string")
    r = df.select(python_parts(F.col("c")).alias("p")).select("p.*").first()
    if expected is None:
        assert r["function_def"] is None
    else:
        fdef, doc, body = expected
        assert (r["function_def"], r["documentation"], r["code_completion"]) == (fdef, doc, body)
        assert r["prompt"] == f'{fdef}    """\n{doc}\n    """'


def test_python_outermost_docstrings(spark):
    src = 'def outer(x):\n    """Outer."""\n    def inner():\n        """Inner."""\n        return 1\n    return inner()\n'
    df = spark.createDataFrame([(src,)], "c string")
    r = df.select(python_parts(F.col("c"), docstrings="outermost").alias("p")).select("p.*").first()
    assert r["code_completion"] == "\tdef inner():\n\t    \"\"\"Inner.\"\"\"\n\t    return 1\n\treturn inner()"


def test_possessive_patterns_match_the_oracle_patterns():
    from codepref.operators.validity import C_LIKE_NOISE, C_LIKE_NOISE_JAVA, PYTHON_NOISE, PYTHON_NOISE_JAVA

    assert C_LIKE_NOISE_JAVA.replace("*+", "*") == C_LIKE_NOISE
    assert PYTHON_NOISE_JAVA.replace("*+", "*") == PYTHON_NOISE


def test_long_inputs_do_not_overflow(spark):
    """Java's regex engine recurses per repetition of a group: extraction and
    the bracket check must stay flat on long outputs and long literals."""
    long_out = "P\n" + "    x = 1\n" * 50000 + "}\nrest"
    long_lit = 'int f() { String s = "' + 'a\\"' * 50000 + '"; return (1); }'
    df = spark.createDataFrame([(long_out, long_lit)], "o string, c string")
    r = df.select(F.length(extract_completion(F.col("o"), F.lit("P"))).alias("n"),
                  balanced(F.col("c"), "java").alias("b")).first()
    assert r["n"] == len("    x = 1\n" * 50000 + "}") and r["b"] is True
