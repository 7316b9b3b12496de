"""Phrase collocations, spelling variants and main text against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codepref.llm import htmltext, phrases, spelling
from codepref.llm.queries import op13_main_text

from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward_docs, lower

# ------------------------------------------------------------------ phrases


def plain_phrases(rows, least, depth, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f[lang].update(zip(*(w[i:] for i in range(k))))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, t.decode(), -a, x, y, n[lang], -s) for i, (s, a, t, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def _random_docs(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Éa", "x\x0by", "U+1F642", "\U0001f642"]
    rows = []
    for i in range(150):
        text = "".join(rnd.choices(words, [40 / (j + 1) for j in range(len(words))])[0] + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!?"])
                       for _ in range(rnd.randrange(60)))
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), rnd.choice([text, text.upper()])))
    return rows + [("en", "hot phrase of five words. " * 300), ("en", None), (None, ""), ("fr", "one")]


@pytest.mark.parametrize("budget", [7, 60, 1_000_000])
def test_collocations(spark, budget, monkeypatch):
    monkeypatch.setattr(phrases, "GATHER", 200)  # several sendings per task
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rows = _random_docs(budget)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, top=40, least=4, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 4, 5, 40)


def test_collocations_joined_and_awkward(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)
    docs = awkward_docs(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, phrases.collocations(docs, least=3).collect())) == plain_phrases(rows, 3, 5, 2000)
    assert phrases.collocations(awkward_docs(spark, empty=True)).count() == 0


def test_another_salt_where_hashes_meet(spark):
    words = spark.createDataFrame([("en", f"w{i}", 200) for i in range(5)], "lang string, word string, f bigint")
    assert phrases.hashed(words, 100)[0] == 0
    twice = words.unionByName(words)  # every hash is met twice, whatever the salt
    with pytest.raises(RuntimeError):
        phrases.hashed(twice, 100)


# ------------------------------------------------------------------ spelling


def plain_words(rows, noise=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_group(vocabulary, ratio=10):
    best, out = {}, {}
    for w, n in vocabulary.items():
        ns = [v for v in vocabulary if near(w, v)]
        top = min(ns, key=lambda v: (-vocabulary[v], v), default=None)
        best[w] = (top if top and vocabulary[top] >= ratio * n else None, len(ns))
    for w in vocabulary:
        root = w
        while best[root][0]:
            root = best[root][0]
        form = best[w][0]
        out[w] = (form, root, vocabulary[w], best[w][1], vocabulary.get(form))
    return out


def _grouped(spark, vocabulary):
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n bigint").repartition(3)
    return {r["word"]: tuple(r)[1:] for r in spelling.group(df).collect()}


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh"])
def test_groups(spark, letters):
    rnd = random.Random(len(letters))
    seeds = ["".join(rnd.choices(letters, k=rnd.randrange(7, 12))) for _ in range(40)]
    words = set(seeds)
    for w in seeds:
        for _ in range(4):
            i = rnd.randrange(len(w) + 1)
            words.add(rnd.choice([w[:i] + rnd.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i + 1:]]))
    vocabulary = {w: rnd.choice([2, 3, 20, 30, 200, 300, 4000]) for w in words if w}
    assert _grouped(spark, vocabulary) == plain_group(vocabulary)


def test_ends_runs_chains_and_long_words(spark):
    vocabulary = {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaab": 2000, "baaaaaaa": 2000, "abcdefg": 5, "bcdefgh": 5,
                  "x" * 30_000: 2, "x" * 29_999 + "y": 50, "x" * 30_001: 50, "y" + "x" * 29_999: 3, "zzzzzzz": 9}
    assert _grouped(spark, vocabulary) == plain_group(vocabulary)


def test_words_and_awkward(spark):
    docs = awkward_docs(spark)
    long = "ab" * 300_000 + " " + "Straße-Straße STRASSE façade FAÇADE " * 9
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, long), (77, long), (None, long)], "doc_id bigint, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for noise in (31, 2):
        got = {r["word"]: r["n"] for r in spelling.words(docs, noise).collect()}
        assert got == plain_words(rows, noise)
    vocabulary = {w: n for w, n in plain_words(rows, 2).items() if len(w) < 1000}
    assert _grouped(spark, vocabulary) == plain_group(vocabulary)
    assert spelling.group(spelling.words(awkward_docs(spark, empty=True))).count() == 0


# ------------------------------------------------------------------ main text


def _texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, host string, text string, deleted string")
    return [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in htmltext.main_text(df).collect()]


def _one(spark, html):
    return _texts(spark, [(1, "http://a/b", html, "h", "t", "d")])[0][2]


CASES = [
    ("<article><h1>T&amp;C</h1><p>one  <b>two</b>\n three<br>four<p>five</article><footer>f</footer>", "T&C one two three four five"),
    ("<nav><a>x</a></nav><main><p>a</p><aside>no</aside><p>b</p></main><p>out</p>", "a b"),
    ("<body><div class='cookie-notice'>n</div><div id=sideBar>s</div><p>text</p><ul><li><a>1</a><li><a>2</a><li><a>3</a></ul></body>", "text"),
    ("<article><p>a</p><section class='comments'><p>troll</p></section><div role='alert'>no</div><form>f</form></article>", "a"),
    ("<article>a<article class=comment>b</article></article>", "a"),
    ("<article><p>a</p></article><article><p>b</p></article>", "a b"),
    ("<p>1 &lt; 2 &amp;amp; &#233;&nbsp;x</p><script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>y</p>", "1 < 2 &amp; é x y"),
    ("<form><article><p>in a form</p></article></form>", "in a form"),
    ("<div class='page header'><main><p>laid out oddly</p></main></div>", "laid out oddly"),
    ("plain text, 1 < 2 and <3", "plain text, 1 < 2 and <3"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<p title='a>b' class=\"x\">q</p><p>un<i>clo</b>sed", "q unclosed"),
    ("<article><header><h1>Head</h1></header><p>x</p><footer>by me</footer></article>", "Head x"),
    ("", ""), (None, ""), ("<p> \n </p>", ""), ("<article></article><p>rest</p>", "rest"),
    ("<header>Site</header><h1>Title</h1><div>a<div>b</div>c</div>", "Title a b c"),
    ("<p>a</p><noscript>js</noscript><select><option>o</select><button>b</button><textarea><p>t</p></textarea><p>z", "a z"),
    ("<article><p>" + "x " * 100_000 + "</p></article>", ("x " * 100_000).strip()),
]


def test_pages_by_hand(spark):
    got = _texts(spark, [(i, f"http://h{i}/", html, "h", "t", "d") for i, (html, _) in enumerate(CASES)])
    assert {g[0]: g[2] for g in got} == {i: want for i, (_, want) in enumerate(CASES)}
    assert all(g[3] == len(g[2]) for g in got)


def test_templates_of_a_host(spark):
    page = "<div><div>Our shop</div><span>menu</span></div><div><h2>{0}</h2><p>text {0}</p></div><div><p>Terms apply</p></div>"
    shop = [(i, f"http://Shop.example:80/{i}", page.format(i), "", "", "") for i in range(6)]
    other = [(10, "http://other.example/", page.format(10), "", "", "")]
    copies = [(20 + i, "http://copy.example/", "<div><p>same text</p></div>", "", "", "") for i in range(9)]
    got = {g[0]: g[2] for g in _texts(spark, shop + other + copies)}
    for i in range(6):
        assert got[i] == f"{i} text {i}"  # recurs on the host
    assert got[10] == "Our shop menu 10 text 10 Terms apply"  # one page tells nothing
    assert all(got[20 + i] == "same text" for i in range(9))  # copies are one page


def test_passages_shared_inside_articles_stay(spark):
    pages = [(i, "http://a.example/", f"<article><p>shared passage</p><p>own {i}</p>{'<p>Subscribe now</p>' if i else ''}</article>",
              "", "", "") for i in range(12)]
    shared = [(i, u, h if i < 6 else h.replace("shared passage", f"passage {i}"), a, b, c) for i, u, h, a, b, c in pages]
    got = {g[0]: g[2] for g in _texts(spark, shared)}
    assert got[0] == "shared passage own 0" and got[3] == "shared passage own 3"
    assert got[9] == "passage 9 own 9"  # "Subscribe now" stands on 11 of 12


def test_joined_deletions_and_awkward_pages(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "BROADCAST_HASHES", -1)
    page = "<div>Banner text</div><p>{0}</p>"
    rows = [(i, "http://a/", page.format(i), "", "", "") for i in range(5)]
    rows += [rows[0], rows[0], (None, None, None, "", "", ""), (7, None, "<p>no host</p>", "", "", ""), (8, "nonsense", "", "", "", "")]
    got = _texts(spark, rows)
    assert sorted((str(g[0]), g[2]) for g in got) == sorted([(str(i), str(i)) for i in (0, 0, 0, 1, 2, 3, 4)] + [("None", ""), ("7", "no host"), ("8", "")])
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert htmltext.main_text(empty).count() == 0


def test_query_against_the_layout_of_the_test_pages(spark):
    """The given pages have one article each; its text by patterns alone."""
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    for r in op13_main_text(spark, SF_SMALL).select("page_id", "text", "n_chars").collect():
        inner = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.split("<[^>]+>", re.sub("</?b>", "", inner))
        want = " ".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", 5, "y")], "page_id bigint, url string, html string, hash int, key string")
    assert htmltext.main_text(df).columns == ["page_id", "url", "text", "n_chars"]
    docs = awkward_docs(spark).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("lang_", F.lit("x"))
    assert spelling.words(docs).columns == ["word", "n"]
