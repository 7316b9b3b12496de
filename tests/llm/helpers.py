"""Small tables with every awkward case, and plain-Python counterparts."""

from __future__ import annotations

import re
import zlib

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _pid string, h int, row int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def awkward_docs(spark, empty: bool = False):
    """Nulls, empty, white space, very long, repeated rows, ties, one hot source,
    and extra columns named like the operators' own."""
    sents = ["the quick brown fox jumps over the lazy dog and runs far away from here today",
             "a wholly different sentence about rivers mountains and the long road to the sea",
             "Étranger façade naïve über coöperate résumé señor año — dash"]
    texts = [None, "", " \t\n ", "one", "one", "Two words", *sents, sents[0] + " again", sents[0].upper(),
             " ".join(sents * 40), "x" * 50_000, "\n".join(sents), "\n".join(sents + sents), "!!! ??? ..."]
    rows = [(i, t, "en", None if i % 7 == 0 else ("hot" if i % 2 else f"s{i % 3}"), 0, "s", "p", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[0], (None, sents[1], None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.limit(0) if empty else df


def components(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
