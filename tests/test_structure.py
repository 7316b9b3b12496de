"""V2 against a plain lexer that reads code one character at a time."""

import unicodedata

from pyspark.sql import functions as F

from codepref.operators.structure import JAVA_WORDS, PRIMITIVES, well_formed
from codepref.operators.validity import structural, valid_code

JAVA = {
    True: ['int f() { return "}"; }', "", 'String s = """\n a "q" \\""" }\n""";', "char c = '\\'';", "char c = '\\u0041', d = '\"';",
           "List<String> x = new ArrayList<>();", "import java.util.*;", "for(;;) { i++; }", "@Foo Bar baz;", "/* ( */ f(); // )",
           "Map<String, List<Integer>> m = null;", "int[] a = {1, 2,};", "x = -1 + 0x1F * 1.5e3f;", 'case "a": return 5;',
           "y = x ? \"a\" : 'b';", "sealed interface A permits B {}", 's = "a\\"" + b; // } "', "f(x -> { return x; });",
           "s = \"it's\" + '\"';", "/** doc */ public static void main(String... a) throws A, B { a[0] += \"\\\\\"; }"],
    False: ["int int int", "char c = 'ab';", "a = = b;", "f(a, , b);", "Foo bar baz;", "x = a + ;", "/* a", 's = "abc', 'x = "a" "b";',
            "f(a,);", "int return 5;", "if (a && ) {}", "x = 5 apples;", "f([)];", "}{", 's = """\nabc""', "f(, a);"]}
KOTLIN = {
    True: ['val s = "${if (a) "}" else "b"}"', "/* a /* b */ c */ f()", 'val r = """a ${x + "}"} " """"', 'val r = """\\"""',
           "val a = 1 shl 2", "val x: Map<A, B> = y", 'val s = "a"\n"b"', "f(a,)", "val c = '}'", 'val s = "\\${x}"', 'val s = "$x"',
           'val s = "${a["k"]}" // "', "fun f(a: Int): Int { return a }", 'val t = "${"${"}"}"}"', 'val s = "${ /* } */ a }"',
           'val q = """${"""x"""}"""', "a++ == b", 'val e = ""', '// ${ "\nval x = 1', "f(*a, x = *b)", 'val s = "${a.map { "<$it>" }}"'],
    False: ['val s = "${if (a) "}" else "b"', "/* a /* b */ f(", 'val s = "a" "b"', "val x = \n )", "x = = y", 'val s = "${x',
            'val t = "a${b}c${d', 'val s = "${a + }"', "f((a)", 'val s = """abc""', 'val s = "a\nb"', "f(,)"]}


class Plain:
    """Tokens of one code as (kind, text); kind "broken" where a literal or comment does not end."""

    def __init__(self, code, lang):
        self.c, self.java, self.i, self.out = code, lang == "java", 0, []
        self.code(None)

    def at(self, s):
        return self.c.startswith(s, self.i)

    def put(self, kind, text=""):
        self.out.append((kind, text))

    def code(self, until):
        """Reads up to an ``until`` that closes a template; whether it came."""
        depth, c = 0, self.c
        while self.i < len(c):
            x = c[self.i]
            if until and x == until and depth == 0:
                return True
            depth += (x == "{") - (x == "}")
            if self.at("//"):
                while self.i < len(c) and c[self.i] != "\n":
                    self.i += 1
            elif self.at("/*"):
                self.comment()
            elif self.at("*/"):
                self.put("broken")
                self.i += 2
            elif self.at('"""'):
                self.raw()
            elif x == '"':
                self.string()
            elif x == "'":
                self.char()
            elif x == "\\" and not self.java and "$" in c:
                self.put("broken")
                self.i += 2
            else:
                self.plain(x)
        return until is None

    def comment(self):
        depth, self.i = 1, self.i + 2
        while depth and self.i < len(self.c):
            if self.at("*/"):
                depth, self.i = depth - 1, self.i + 2
            elif self.at("/*") and not self.java:
                depth, self.i = depth + 1, self.i + 2
            else:
                self.i += 1
        if depth:
            self.put("broken")

    def template(self):
        self.i += 2
        self.put("(", "(")
        if self.code("}"):
            self.put(")", ")")
            self.i += 1
        else:
            self.put("broken")

    def raw(self):
        self.put("value")
        self.i += 3
        while self.i < len(self.c):
            if self.java and self.c[self.i] == "\\":
                self.i += 2
            elif not self.java and self.at("${"):
                self.template()
            elif self.at('"""'):
                self.i += 3
                while not self.java and self.at('"'):
                    self.i += 1
                return
            else:
                self.i += 1
        self.put("broken")

    def string(self):
        self.put("value")
        self.i += 1
        while self.i < len(self.c) and self.c[self.i] != "\n":
            if self.c[self.i] == '"':
                self.i += 1
                return
            if self.c[self.i] == "\\":
                self.i += 2
            elif not self.java and self.at("${"):
                self.template()
            else:
                self.i += 1
        self.put("broken")

    def char(self):
        c, i = self.c, self.i
        end = i + 2
        if c[i + 1:i + 2] == "\\":
            u = 1 if not self.java else len(c[i + 2:]) - len(c[i + 2:].lstrip("u"))
            end = i + 6 + u if c[i + 2:i + 3] == "u" else i + 3
        if c[i + 1:i + 2] not in ("'", "\n", "") and c[end:end + 1] == "'":
            self.put("value")
            self.i = end + 1
        else:
            self.put("broken")
            self.i += 1

    def plain(self, x):
        i, c = self.i, self.c

        def run(ok):
            j = self.i
            while j < len(c) and ok(c[j]):
                j += 1
            return j

        def name(y):
            return y in "_$" or unicodedata.category(y)[0] in "LN"

        if x == "\n" and not self.java:
            self.put("newline")
        elif x in "(){}[],;":
            self.put(x, x)
        elif x == "@" or x == "_" or unicodedata.category(x)[0] == "L":
            self.i += x == "@"
            self.i = run(name)
            word = c[i:self.i]
            kind = "name" if not self.java else "primitive" if word in PRIMITIVES else "keyword" if word in JAVA_WORDS else "name"
            self.put("note" if x == "@" else kind, word)
            return
        elif unicodedata.category(x)[0] == "N":
            self.i = run(name)
            if self.at(".") and c[self.i + 1:self.i + 2].isdigit():
                self.i += 1
                self.i = run(name)
            self.put("value")
            return
        elif x == ".":
            self.i = run(lambda y: y == ".")
            self.put("dot")
            return
        elif x in "-+*/%&|^!=<>?:~":
            self.i = run(lambda y: y in "-+*/%&|^!=<>?:~")
            self.put("op", c[i:self.i])
            return
        self.i += 1


def plain_verdict(code, lang):
    out = Plain(code, lang).out
    stack = []
    for kind, _ in out:
        if kind in "([{":
            stack.append(kind)
        elif kind in ")]}" and (not stack or stack.pop() + kind not in ("()", "[]", "{}")):
            return False
    close = [t for t in out if t[0] != "newline"]
    needs = [k == "op" and t != "*" and t not in ("++", "--") and t[-1] in "=+-*/%&|^" for k, t in close]
    after = [k == "op" and t != "*" and t[0] in "=/%|^<>&*" for k, t in close]
    kinds = [k for k, _ in close]
    for i in range(len(close) - 1):
        nxt = kinds[i + 1]
        if needs[i] and (nxt in (")", "]", "}", ";", ",") or after[i + 1]) or kinds[i] in ("(", "[", ",") and nxt == "," \
                or kinds[i] == "," and nxt == ";":
            return False
    lines = [k for k, _ in out]
    for a, b, c in zip(lines, [*lines[1:], ""], [*lines[2:], "", ""]):
        if a == b == "value" or lang == "java" and (
                a == "," and b in (")", "]") or a == "primitive" and b in ("primitive", "keyword", "value")
                or {a, b} == {"value", "name"} or a == b == c == "name"):
            return False
    return not stack and "broken" not in lines


def _verdicts(spark, cases, lang):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r["ok"] for r in df.select("i", well_formed(F.col("c"), lang).alias("ok")).orderBy("i").collect()]


def test_by_hand(spark):
    for lang, cases in (("java", JAVA), ("kotlin", KOTLIN)):
        for want, codes in cases.items():
            got = _verdicts(spark, codes, lang)
            assert [c for c, g in zip(codes, got) if g is not want] == []
            assert [c for c in codes if plain_verdict(c, lang) is not want] == []


def test_with_one_character_less_or_twice(spark):
    for lang, cases in (("java", JAVA), ("kotlin", KOTLIN)):
        codes = [c for cs in cases.values() for c in cs]
        broken = sorted({c[:i] + c[i + 1:] for c in codes for i in range(len(c))} | {c[:i] + c[i] + c[i:] for c in codes for i in range(len(c))})
        got = _verdicts(spark, broken, lang)
        wrong = [(c, g) for c, g in zip(broken, got) if g is not plain_verdict(c, lang)]
        assert wrong == [], (lang, len(wrong), len(broken), wrong[:8])


def test_dispatch_and_null(spark):
    df = spark.createDataFrame([("int int int", "java"), ("a b c", "kotlin"), ("def f(:", "python"), (None, "java")], "c string, l string")
    assert [r[0] for r in df.select(structural(F.col("c"), F.col("l"))).collect()] == [False, True, False, None]
    assert [r[0] for r in df.select(valid_code(F.col("c"), F.col("l"))).collect()] == [False, True, False, None]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "java")], "c string, l string").select(structural(F.col("c"), F.col("l")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
