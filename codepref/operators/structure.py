"""Structural validity of Java and Kotlin code (V2): a lexer and a check of its tokens.

Code is masked first: literals become one mark, comments go. Java's literals and
comments, and Kotlin's as long as no template ``${}`` and no comment in a comment stands
in the code, are told apart by one regular expression that reads from left to right.
Other Kotlin code goes through a state machine in the row, a fold over its tokens with a
stack of modes (string, raw string, template, line comment, nested comment) and brackets.

Each token left is put into a class of one letter. The code is well formed if brackets
match, every literal and comment ends, and no two or three neighbours are of classes that
the grammar never lets stand together: an operator without a right side (``a + )``,
``c = = b``), a comma after ``(`` or another comma, two literals, and in Java also a
primitive type before a type or keyword (``int int``) and three names in a row.

Everything is a Spark expression. What needs names and types (an undeclared variable, a
wrong argument) is left to a compiler, which :func:`~codepref.operators.validity.valid_code`
takes as a checker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the Java language specification.
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short", "void")
JAVA_WORDS = (
    "abstract", "assert", "break", "case", "catch", "class", "const", "continue", "default", "do", "else", "enum",
    "extends", "final", "finally", "for", "goto", "if", "implements", "import", "instanceof", "interface", "native",
    "new", "package", "private", "protected", "public", "return", "static", "strictfp", "super", "switch",
    "synchronized", "this", "throw", "throws", "transient", "try", "volatile", "while", "true", "false", "null",
    "exports", "module", "non", "open", "opens", "permits", "provides", "record", "requires", "sealed", "to",
    "transitive", "uses", "var", "when", "with", "yield",
)

#: Stands behind each masked literal and in place of each comment.
MARK = "\x01"
# Loops are unrolled and possessive: Java's engine neither recurses nor backtracks in them.
_STRING = r'(")[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*+"
JAVA_NOISE = (r'(")""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""|' + _STRING
              + r"|(')(?:[^'\\\n]|\\(?:u++[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n]))'|" + _COMMENT)
KOTLIN_NOISE = r'(")""[\s\S]*?"{3,}+|' + _STRING + r"|(')(?:[^'\\\n]|\\(?:u[0-9a-fA-F]{4}|[^\n]))'|" + _COMMENT

_WORD = r"@?[\p{L}_](?:[\p{L}\p{N}_]|\$(?!\{))*+"
_REST = r"|\p{N}[\p{L}\p{N}_]*+(?:\.\p{N}[\p{L}\p{N}_]*+)?|[(){}\[\],;]|\.++|/\*|\*/"
_SIGNS = "[-+*/%&|^!=<>?:~]"
MASKED_TOKEN = "[\"']" + MARK + "?|" + _WORD + _REST + f"|{_SIGNS}++"
#: Tokens of code that is not masked; a run of quotes, or quotes behind a backslash, is one.
RAW_TOKEN = (r'"++|\\(?:"++|\$\{|[\s\S])|' + r"'(?:[^'\\\n]|\\(?:u[0-9a-fA-F]{4}|[^\n]))'|'|\n|//\*?+|/\*|\*/|\$\{|" + _WORD + _REST
             + rf"|(?:(?!\*/|/[/*]){_SIGNS})++")

#: Neighbours that no grammar has: x is a literal or comment that does not end, o and q
#: are operators that need a right side, q and b such that need a left one.
_NEVER = r"x|[oq]n*[)\]};,qb]|[(\[,]n*,|,n*;|l[l]"
NEVER = {"java": _NEVER + r"|,[)\]]|www|p[pkl]|lw|wl", "kotlin": _NEVER}


def _class(t: Column, java: bool) -> Column:
    """The class of a token, one letter (brackets, commas and semicolons are their own)."""
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    left = first.isin(*"=/%|^<>&*")
    right = last.isin(*"=+-*/%&|^") & ~t.isin("++", "--")
    word = F.when(t.isin(*PRIMITIVES), "p").when(t.isin(*JAVA_WORDS), "k").otherwise("w") if java else F.lit("w")
    return (F.when(first.isin(*"(){}[],;\n"), F.when(first == "\n", "n").otherwise(first))
            .when(t.isin("/*", "*/", "'", '"', "\\"), "x").when(first.isin('"', "'"), "l").when(first == "@", "a")
            .when(t.rlike(r"^[\p{L}_]"), word).when(t.rlike(r"^\p{N}"), "l").when((first == ".") | (t == "*"), "d")
            .when(right & left, "q").when(right, "o").when(left, "b").otherwise("u"))


def _closed(classes: Column) -> Column:
    """Whether the brackets in a string of classes match."""
    brackets = F.regexp_extract_all(classes, F.lit(r"[(){}\[\]]"), 0)

    def step(stack, x):
        opener = F.when(x == ")", "(").when(x == "]", "[").otherwise("{")
        return (F.when(stack == "!", "!").when(x.isin("(", "[", "{"), F.concat(x, stack))
                .when(F.substring(stack, 1, 1) == opener, F.substr(stack, F.lit(2))).otherwise("!"))

    return F.aggregate(brackets, F.lit(""), step) == ""


def _by_mask(code: Column, noise: str, java: bool) -> Column:
    masked = F.regexp_replace(code, noise, "$1$2$3" + MARK)
    token = MASKED_TOKEN if java else MASKED_TOKEN + "|\n"
    return F.array_join(F.transform(F.regexp_extract_all(masked, F.lit(token), 0), lambda t: _class(t, java)), "")


def _by_modes(code: Column) -> Column:
    """The classes of Kotlin code with templates or nested comments. The stack's top is
    its first letter: a bracket, s and r in strings, $ in a template, l and c in comments."""
    def step(a, t):
        stack, out = a["stack"], a["out"]
        top, below = F.substring(stack, 1, 1), F.substr(stack, F.lit(2))
        escaped = F.substring(t, 1, 1) == "\\"
        # the quotes that count: in a string a backslash takes the first of its run
        quotes = F.when(F.substring(t, -1, 1) == '"', F.length(t) - F.when(escaped, F.when(top == "r", 1).otherwise(2)).otherwise(0)).otherwise(0)

        def to(s, o=None):
            return F.struct(s.alias("stack"), (out if o is None else F.concat(out, o)).alias("out"))

        push = lambda m: F.concat(F.lit(m), stack)
        opened = (F.when(quotes == 1, to(push("s"), F.lit("l"))).when((quotes == 2) | (quotes > 5), to(stack, F.lit("l")))
                  .otherwise(to(push("r"), F.lit("l"))))
        ended = (F.when(quotes == 1, to(below)).when(quotes == 2, to(stack, F.lit("l"))).when(quotes == 3, to(below, F.lit("l")))
                 .otherwise(to(F.concat(F.lit("r"), below), F.lit("l"))))
        template = F.substring(t, -2, 2) == "${"
        in_string = (F.when(quotes > 0, ended).when(t == "${", to(push("$"), F.lit("(")))
                     .when(t == "\n", to(stack, F.lit("x"))).otherwise(a))
        in_raw = F.when(quotes >= 3, to(below)).when(template, to(push("$"), F.lit("("))).otherwise(a)
        in_comment = F.when(t == "*/", to(below)).when(t.isin("/*", "//*"), to(push("c"))).otherwise(a)
        in_code = (F.when(escaped, to(stack, F.lit("x"))).when(quotes > 0, opened).when(t.startswith("//"), to(push("l"))).when(t == "/*", to(push("c")))
                   .when((t == "}") & (top == "$"), to(below, F.lit(")"))).when(t == "${", to(push("{"), F.lit("{")))
                   .when(t.isin("(", "[", "{"), to(F.concat(t, stack), t))
                   .when(t.isin(")", "]", "}"), F.when(top == F.translate(t, ")]}", "([{"), to(below, t)).otherwise(to(stack, F.lit("x"))))
                   .otherwise(to(stack, _class(t, False))))
        return (F.when(top == "l", F.when(t == "\n", to(below, F.lit("n"))).otherwise(a)).when(top == "c", in_comment)
                .when(top == "s", in_string).when(top == "r", in_raw).otherwise(in_code))

    start = F.struct(F.lit("").alias("stack"), F.lit("").alias("out"))
    end = lambda a: F.when(a["stack"].isin("", "l"), a["out"]).otherwise("x")
    return F.aggregate(F.regexp_extract_all(code, F.lit(RAW_TOKEN), 0), start, step, end)


def java_classes(code: Column) -> Column:
    """The classes of Java code's tokens, one letter each."""
    return _by_mask(code, JAVA_NOISE, True)


def kotlin_classes(code: Column) -> Column:
    """The classes of Kotlin code's tokens; a template stands in round brackets."""
    nested = F.contains(code, F.lit("${")) | F.regexp_like(code, F.lit(r"/\*(?:(?!\*/|/\*)[\s\S])*+/\*"))
    return F.when(code.isNull(), None).when(nested, _by_modes(code)).otherwise(_by_mask(code, KOTLIN_NOISE, False))


def well_formed(code: Column, language: str) -> Column:
    """V2: whether Java or Kotlin code is well formed (null: null)."""
    classes = java_classes(code) if language == "java" else kotlin_classes(code)
    # bound once: Spark would evaluate the classes for each of the two checks
    return F.transform(F.array(classes), lambda s: ~s.rlike(NEVER[language]) & _closed(s))[0]
