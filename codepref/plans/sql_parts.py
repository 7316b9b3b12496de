"""DuckDB SQL text for the oracles.

Each builder writes, independently of the Spark code, the SQL form of one
operator's semantics; the driver compares the two engines' results. Spark
lambda indexes are 0-based and DuckDB's 1-based, which is consistent within
each engine because an index is only compared with indexes of the same list.
"""

from __future__ import annotations

import keyword

from codepref.functions.text import sql_hash

__all__ = ["q", "sql_hash", "sql_extract", "sql_balanced", "sql_eligible", "sql_corrupt",
           "sql_remove_markers"]

# The oracles hold their own constants, so that a wrong list in the Spark code
# shows. Public language specifications and output formats.
SEQUENCE_MARKERS = ("<｜begin▁of▁sentence｜>", "<｜end▁of▁sentence｜>")
COMMENT_PREFIX = {"java": "//", "python": "#", "kotlin": "//"}
KEYWORDS = {
    "java": """abstract assert boolean break byte case catch char class const continue default do double else
        enum extends final finally float for goto if implements import instanceof int interface long native new
        package private protected public return short static strictfp super switch synchronized this throw throws
        transient try void volatile while""".split(),
    "python": [*keyword.kwlist],
    "kotlin": """as break class continue do else false for fun if in interface is null object package return super
        this throw true try typealias typeof val var when while catch const constructor finally import
        abstract annotation companion crossinline data enum external final inline internal lateinit open operator
        out override private protected public sealed suspend vararg""".split(),
}
SYMBOLS = [*"{}()[];,.+-*/&|^%!~?:<>='", '"']
PYTHON_SYMBOLS = ["#"]
BRACKETS = "[][(){}]"
LINE_STRING = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"' + r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
PYTHON_NOISE = r'(?s)""".*?"""|' + r"'''.*?'''|" + LINE_STRING + r"|#[^\n]*"
# Unicode white space, as str.strip sees it.
UNICODE_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]"

LINE_BREAKS_RE2 = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
WORD = "\\p{L}\\p{N}_"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_remove_markers(expr: str) -> str:
    for m in SEQUENCE_MARKERS:
        expr = f"replace({expr}, {q(m)}, '')"
    return expr


def sql_extract(o: str, p: str) -> str:
    """R1 in DuckDB."""
    rest = (f"substr({o}, CASE WHEN instr({o}, {p}) > 0 THEN instr({o}, {p}) + length({p}) "
            f"ELSE length({p}) END)")
    ls = f"list_filter(regexp_split_to_array({rest}, {q(LINE_BREAKS_RE2)}), lambda l: l <> '')"
    stop = (f"coalesce(list_position(list_transform(_ls, lambda l: NOT (starts_with(l, ' ') "
            f"OR starts_with(l, chr(9)))), true), 0)")
    body = (f"CASE WHEN _stop = 0 THEN _ls WHEN _ls[_stop] = '}}' THEN _ls[1:_stop] "
            f"ELSE _ls[1:_stop - 1] END")
    return (f"(SELECT array_to_string({body}, chr(10)) FROM (SELECT _ls, {stop} AS _stop "
            f"FROM (SELECT {ls} AS _ls)))")


# V2: every token of the code, literals and comments whole, as RE2 reads them.
TRIPLE = {"java": r'"""(?:[^"\\]|\\(?s:.)|"[^"]|""[^"])*"""', "kotlin": r'"""(?s:.*?)""""*'}
CHARACTER = r"'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[^\n])'"
TOKENS = {k: v + r'|"(?:[^"\\\n]|\\.)*"|' + CHARACTER + r"|/\*(?s:.*?)\*/|//[^\n]*|[\"']|@?[\p{L}_][\p{L}\p{N}_$]*"
          r"|\p{N}[\p{L}\p{N}_]*(?:\.\p{N}[\p{L}\p{N}_]*)?|/\*|\*/|[-+*/%&|^!=<>?:~]+|[][(){},;]|\.+|\n" for k, v in TRIPLE.items()}
PRIMITIVE = ["boolean", "byte", "char", "double", "float", "int", "long", "short", "void"]
CONTEXTUAL = """true false null exports module non open opens permits provides record requires sealed to transitive uses
    var when with yield""".split()


def _kinds(code: str, lang: str) -> str:
    """The kinds of a code's tokens but for comments, as a list."""
    tokens = f"CASE {lang} WHEN 'java' THEN regexp_extract_all({code}, {q(TOKENS['java'])}) ELSE regexp_extract_all({code}, {q(TOKENS['kotlin'])}) END"
    words = sql_list([w for w in KEYWORDS["java"] if w not in PRIMITIVE] + CONTEXTUAL)
    kind = (f"CASE WHEN x = chr(10) THEN 'newline' WHEN x IN (chr(34), chr(39), '/*', '*/') THEN 'broken' WHEN x[1] IN (chr(34), chr(39)) THEN 'value' "
            f"WHEN regexp_matches(x, '^[][(){{}},;]') THEN x WHEN x[1] = '@' THEN 'note' WHEN regexp_matches(x, '^\\p{{N}}') THEN 'value' "
            f"WHEN regexp_matches(x, '^[\\p{{L}}_]') THEN CASE WHEN {lang} <> 'java' THEN 'name' WHEN list_contains({sql_list(PRIMITIVE)}, x) "
            f"THEN 'primitive' WHEN list_contains({words}, x) THEN 'keyword' ELSE 'name' END WHEN x[1] = '.' OR x = '*' THEN 'dot' "
            f"ELSE concat(CASE WHEN contains('=/%|^<>&*', x[1]) THEN 'after' ELSE '' END, '-', CASE WHEN contains('=+-*/%&|^', x[-1]) "
            f"AND x NOT IN ('++', '--') THEN 'before' ELSE '' END) END")
    kept = (f"list_filter({tokens}, lambda x: NOT starts_with(x, '//') AND NOT (starts_with(x, '/*') AND len(x) > 2) "
            f"AND NOT (x = chr(10) AND {lang} = 'java'))")
    return f"list_transform({kept}, lambda x: {kind})"


def sql_balanced(code: str, lang: str) -> str:
    """V2 in DuckDB: neighbours in the list of tokens, and the brackets among them.
    Templates and nested comments are left to the tests."""
    bare = f"regexp_replace({code}, {q(PYTHON_NOISE)}, '', 'g')"
    step = ("CASE WHEN acc = '!' THEN '!' WHEN x IN ('(', '[', '{') THEN x || acc "
            "WHEN substr(acc, 1, 1) = CASE x WHEN ')' THEN '(' WHEN ']' THEN '[' ELSE '{' END "
            "THEN substr(acc, 2) ELSE '!' END")
    fold = f"list_reduce(list_filter(_k, lambda x: x IN ('(', ')', '[', ']', '{{', '}}')), lambda acc, x: {step}, '') = ''"
    pair = ("(_s[i + 1] = 'broken' OR (ends_with(_s[i], '-before') AND (_s[i + 1] IN (')', ']', '}', ';', ',') OR starts_with(_s[i + 1], 'after-'))) "
            "OR (_s[i] IN ('(', '[', ',') AND _s[i + 1] = ',') OR (_s[i] = ',' AND _s[i + 1] = ';'))")
    line = ("(_k[i] = 'value' AND _k[i + 1] = 'value') OR (_java AND ((_k[i] = ',' AND _k[i + 1] IN (')', ']')) "
            "OR (_k[i] = 'primitive' AND _k[i + 1] IN ('primitive', 'keyword', 'value')) OR (_k[i] = 'value' AND _k[i + 1] = 'name') "
            "OR (_k[i] = 'name' AND _k[i + 1] = 'value') OR (_k[i] = 'name' AND _k[i + 1] = 'name' AND _k[i + 2] = 'name')))")
    wrong = (f"len(list_filter(range(0, len(_s)::BIGINT), lambda i: coalesce({pair}, false))) > 0 "
             f"OR len(list_filter(range(1, len(_k)::BIGINT), lambda i: coalesce({line}, false))) > 0")
    whole = (f"(SELECT NOT ({wrong}) AND {fold} FROM (SELECT _k, list_filter(_k, lambda x: x <> 'newline') AS _s, {lang} = 'java' AS _java "
             f"FROM (SELECT {_kinds(code, lang)} AS _k)))")
    python = f"(list_reduce(regexp_extract_all({bare}, {q(BRACKETS)}), lambda acc, x: {step}, '') = '')"
    return f"(CASE WHEN {lang} = 'python' THEN {python} ELSE {whole} END)"


def _words(lang: str) -> str:
    return "CASE " + " ".join(f"WHEN {lang} = {q(k)} THEN {sql_list(v)}" for k, v in KEYWORDS.items()) + " END"


def _prefix(lang: str) -> str:
    return "CASE " + " ".join(f"WHEN {lang} = {q(k)} THEN {q(COMMENT_PREFIX[k])}" for k in KEYWORDS) + " END"


def _toks(line: str, lang: str) -> str:
    return (f"list_filter(regexp_extract_all({line}, {q('[' + WORD + ']+|' + chr(92) + 'S')}), "
            f"lambda t: list_contains({_words(lang)}, t) OR list_contains({sql_list(SYMBOLS)}, t) "
            f"OR ({lang} = 'python' AND list_contains({sql_list(PYTHON_SYMBOLS)}, t)))")


def sql_eligible(code: str, lang: str) -> str:
    """C3 precondition in DuckDB."""
    return (f"(len(list_filter(string_split({code}, chr(10)), lambda l: NOT starts_with("
            f"regexp_replace(l, '^{UNICODE_SPACE}+', ''), {_prefix(lang)}) AND len({_toks('l', lang)}) > 0)) > 0)")


def sql_corrupt(code: str, lang: str, key: str, seed: int = 0, compat: bool = False) -> str:
    """C2-C5 in DuckDB (default whole-token edit; compat: first substring)."""
    h1, h2, h3, h4 = (sql_hash(key, seed, s) for s in (1, 2, 3, 4))
    items = (f"list_transform(string_split({code}, chr(10)), lambda l, i: {{'i': i, 'l': l, "
             f"'toks': {_toks('l', lang)}}})")
    elig = (f"list_filter({items}, lambda s: NOT starts_with(regexp_replace(s.l, '^{UNICODE_SPACE}+', ''), "
            f"{_prefix(lang)}) AND len(s.toks) > 0)")
    syms = sql_list(SYMBOLS + PYTHON_SYMBOLS)
    # misspelling of _tok
    n = "length(_tok)"
    p = f"CAST(_h4 % {n} + 1 AS INTEGER)"
    qq = f"CAST(_h4 % greatest({n} - 1, 1) + 1 AS INTEGER)"
    drop = f"(substr(_tok, 1, {p} - 1) || substr(_tok, {p} + 1))"
    double = f"(substr(_tok, 1, {p}) || substr(_tok, {p}))"
    swap = (f"(substr(_tok, 1, {qq} - 1) || substr(_tok, {qq} + 1, 1) || substr(_tok, {qq}, 1) "
            f"|| substr(_tok, {qq} + 2))")
    mis = (f"CASE WHEN _h3 % 3 = 0 THEN {drop} WHEN _h3 % 3 = 1 THEN {double} "
           f"WHEN {n} >= 2 AND {swap} <> _tok THEN {swap} ELSE {drop} END")
    repl = f"CASE WHEN list_contains({syms}, _tok) THEN '' ELSE {mis} END"
    masked = f"(' ' || regexp_replace(_line, '[^{WORD}]', ' ', 'g') || ' ')"
    pos = ("instr(_line, _tok)" if compat else
           f"CASE WHEN list_contains({syms}, _tok) THEN instr(_line, _tok) "
           f"ELSE instr({masked}, ' ' || _tok || ' ') END")
    new_line = f"(substr(_line, 1, _pos - 1) || _repl || substr(_line, _pos + length(_tok)))"
    edited = (f"array_to_string(list_transform(string_split({code}, chr(10)), "
              f"lambda x, j: CASE WHEN j = _ci THEN _new ELSE x END), chr(10))")
    return (f"(SELECT CASE WHEN {code} = '' THEN '' WHEN _n = 0 THEN NULL ELSE {edited} END FROM ("
            f"SELECT *, {new_line} AS _new FROM ("
            f"SELECT *, {repl} AS _repl, {pos} AS _pos FROM ("
            f"SELECT *, _chosen.i AS _ci, _chosen.l AS _line, "
            f"_chosen.toks[CAST(_h2 % greatest(len(_chosen.toks), 1) + 1 AS INTEGER)] AS _tok FROM ("
            f"SELECT _n, _h2, _h3, _h4, _elig[CAST(_h1 % greatest(_n, 1) + 1 AS INTEGER)] AS _chosen FROM ("
            f"SELECT _elig, len(_elig) AS _n, {h1} AS _h1, {h2} AS _h2, {h3} AS _h3, {h4} AS _h4 FROM ("
            f"SELECT {elig} AS _elig)))))))")
