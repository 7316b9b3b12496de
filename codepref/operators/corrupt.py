"""Negative synthesis (C1-C6): make a one-line, one-token edit that should
break valid code.

All native array expressions, evaluated inside the row: split into lines,
tokenise each line, keep lines that are not comments and hold a token with a
rule, then pick line, token, edit kind and position from seeded md5 hashes
(R2). Picking uniformly among eligible lines equals the reference's rejection
loop in distribution and cannot spin forever: a row with no eligible line
gets NULL (and is not used as a candidate).

Rules: keywords come from the public language specifications; a keyword gets
a misspelling computed in the expression (drop / double / swap a letter at a
hashed position, never equal to the keyword), a symbol gets deleted. A caller
may pass their own keyword and symbol lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepref.functions.text import WORD_CHARS, seeded_hash, tokens

# Keywords per language (public language specifications).
JAVA_KEYWORDS = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class",
    "const", "continue", "default", "do", "double", "else", "enum", "extends", "final",
    "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int",
    "interface", "long", "native", "new", "package", "private", "protected", "public",
    "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this",
    "throw", "throws", "transient", "try", "void", "volatile", "while",
)
PYTHON_KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
    "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise",
    "return", "try", "while", "with", "yield",
)
KOTLIN_KEYWORDS = (
    "as", "break", "class", "continue", "do", "else", "false", "for", "fun", "if", "in",
    "interface", "is", "null", "object", "package", "return", "super", "this", "throw",
    "true", "try", "typealias", "typeof", "val", "var", "when", "while",
    "abstract", "catch", "companion", "const", "data", "enum", "finally", "import",
    "internal", "open", "override", "private", "protected", "public",
    "annotation", "constructor", "crossinline", "external", "final", "inline", "lateinit",
    "operator", "out", "sealed", "suspend", "vararg",
)
# Symbols whose deletion is an edit (all languages).
SYMBOLS = ("{", "}", "(", ")", "[", "]", ";", ",", ".", "+", "-", "*", "/", "&", "|",
           "^", "%", "!", "~", "?", ":", "<", ">", "=", "'", '"')
# Further symbols of one language (a trailing comment mark).
LANGUAGE_SYMBOLS = {"python": ("#",)}
# Line-comment prefix per language.
COMMENT_PREFIX = {"java": "//", "python": "#", "kotlin": "//"}

# Leading white space as ``str.lstrip`` sees it (Unicode).
LEADING_SPACE = "(?U)^\\s+"

KEYWORDS = {"java": JAVA_KEYWORDS, "python": PYTHON_KEYWORDS, "kotlin": KOTLIN_KEYWORDS}


def _by_language(language: Column, values: dict, wrap) -> Column:
    expr = None
    for lang, v in values.items():
        expr = (F.when(language == lang, wrap(v)) if expr is None
                else expr.when(language == lang, wrap(v)))
    return expr.otherwise(F.raise_error(F.concat(F.lit("language not supported: "), language)))


def misspell(tok: Column, h_kind: Column, h_pos: Column) -> Column:
    """Drop, double or swap one letter; the result never equals ``tok``."""
    n = F.length(tok)
    p = (h_pos % n + 1).cast("int")
    drop = F.concat(F.substr(tok, F.lit(1), p - 1), F.substr(tok, p + 1))
    double = F.concat(F.substr(tok, F.lit(1), p), F.substr(tok, p))
    q = (h_pos % F.greatest(n - 1, F.lit(1)) + 1).cast("int")
    swap = F.concat(F.substr(tok, F.lit(1), q - 1), F.substr(tok, q + 1, F.lit(1)),
                    F.substr(tok, q, F.lit(1)), F.substr(tok, q + 2))
    kind = h_kind % 3
    return (F.when(kind == 0, drop).when(kind == 1, double)
            .when((n >= 2) & (swap != tok), swap).otherwise(drop))


def _has_rule(t: Column, language: Column, kw: dict, symbols) -> Column:
    """Token has a rule: ``IN`` lists become hash-set lookups (InSet)."""
    expr = None
    for lang, words in kw.items():
        rules = (*words, *LANGUAGE_SYMBOLS.get(lang, ()))
        expr = (F.when(language == lang, t.isin(*rules)) if expr is None
                else expr.when(language == lang, t.isin(*rules)))
    return expr.otherwise(F.lit(False)) | t.isin(*symbols)


def with_corruption(df: DataFrame, code: str = "code", language: str = "language",
                    key: str = "row_id", out: str = "corrupted", seed: int = 0,
                    compat: bool = False, keywords: dict | None = None,
                    symbols=SYMBOLS) -> DataFrame:
    """Add ``out`` = corrupted code ('' for empty code, NULL if no line
    qualifies).

    Staged projections: Spark resolves every copy of a lambda with fresh
    variables, so a single expression would re-tokenise all lines for each
    reference. Each stage is its own projection, and Spark keeps a non-cheap
    column that is read twice in its own projection instead of inlining it.

    ``compat=True`` replaces the first substring occurrence of the token in the
    line (the reference's ``str.replace(t, r, 1)``); by default the edit hits
    the first whole-token occurrence."""
    kw = keywords or KEYWORDS
    lang, c = F.col(language), F.col(code)
    prefix = _by_language(lang, {k: COMMENT_PREFIX.get(k, "//") for k in kw}, F.lit)
    items = F.transform(F.split(c, "\n"), lambda l, i: F.struct(
        i.alias("i"), l.alias("l"),
        F.filter(tokens(l), lambda t: _has_rule(t, lang, kw, symbols)).alias("toks")))
    elig = F.filter(items, lambda s: ~F.regexp_replace(s["l"], LEADING_SPACE, "").startswith(prefix)
                    & (F.size(s["toks"]) > 0))
    h = [seeded_hash(key, seed, step) for step in (1, 2, 3, 4)]
    d = df.withColumn("_ce", elig)
    d = d.withColumn("_cc", F.try_element_at(F.col("_ce"), (h[0] % F.greatest(F.size("_ce"), F.lit(1)) + 1).cast("int")))
    toks = F.col("_cc.toks")
    d = d.withColumn("_ct", F.try_element_at(toks, (h[1] % F.greatest(F.size(toks), F.lit(1)) + 1).cast("int")))
    tok, line = F.col("_ct"), F.col("_cc.l")
    is_sym = tok.isin(*symbols, *(s for more in LANGUAGE_SYMBOLS.values() for s in more))
    repl = F.when(is_sym, F.lit("")).otherwise(misspell(tok, h[2], h[3]))
    if compat:
        pos = F.instr(line, tok)
    else:
        masked = F.concat(F.lit(" "), F.regexp_replace(line, f"[^{WORD_CHARS}]", " "), F.lit(" "))
        pos = F.when(is_sym, F.instr(line, tok)).otherwise(
            F.instr(masked, F.concat(F.lit(" "), tok, F.lit(" "))))
    d = d.withColumn("_cp", pos).withColumn("_cr", repl)
    new_line = F.concat(F.substr(line, F.lit(1), F.col("_cp") - 1), F.col("_cr"),
                        F.substr(line, F.col("_cp") + F.length(tok)))
    lines = F.split(c, "\n")
    ci = F.col("_cc.i")
    edited = F.array_join(F.concat(F.slice(lines, F.lit(1), ci), F.array(new_line),
                                   F.slice(lines, ci + 2, F.size(lines))), "\n")
    result = (F.when(c == "", F.lit(""))
              .when(F.size("_ce") == 0, F.lit(None).cast("string"))
              .otherwise(edited))
    return d.withColumn(out, result).drop("_ce", "_cc", "_ct", "_cp", "_cr")


def has_eligible_line(code: Column, language: Column, keywords: dict | None = None,
                      symbols=SYMBOLS) -> Column:
    """C3 precondition as a cheap flag (used to pick quota candidates before
    corrupting only the chosen rows)."""
    kw = keywords or KEYWORDS
    prefix = _by_language(language, {k: COMMENT_PREFIX.get(k, "//") for k in kw}, F.lit)
    return F.exists(F.split(code, "\n"), lambda l: ~F.regexp_replace(l, LEADING_SPACE, "").startswith(prefix)
                    & F.exists(tokens(l), lambda t: _has_rule(t, language, kw, symbols)))
