"""WARC archives, quotation linking and the pipeline."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codepref.llm import decontam, quotes, sharding, simhash, warc
from codepref.llm.common import scratch
from codepref.llm.queries import op1_warc_transactions
from tests.llm import helpers
from tests.llm.helpers import awkward_docs


# --- WARC --------------------------------------------------------------------

PAGES = [(1, "http://a.example/x", "é" * 600), (2, "http://b.example", "é" * 600), (9, "https://c.example/y?z", "é" * 600),
         (3, "http://a.example/", "short"), (4, "http://a.example/", "short"), (5, None, None), (6, "http://d.example/", ""),
         (7, "http://e.example/", "holds WARC/1.1\r\nWARC-Type: response\r\n\r\nand WARC/ again\r\n\r\n" * 30), (8, "http://e.example/\r\nX: y", "x" * 200_000),
         (10, "http://f.example/", "tail\r\n\r\n")]


def written(spark, pages, compression="gzip"):
    path = scratch(spark, "warc-test")
    warc.write_archives(warc.page_records(pages), path, compression)
    return path


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    pages = spark.createDataFrame([(*p, "t") for p in PAGES], "page_id bigint, url string, html string, type string").coalesce(1)
    records = warc.read_records(spark, written(spark, pages, compression)).cache()
    assert Counter(r["type"] for r in records.collect()) == {"request": 10, "metadata": 10, "response": 8, "revisit": 2}
    assert not records.where("truncated").count()
    rows = warc.assemble(records.withColumn("payload", warc.http_payload(F.col("block")))).collect()
    assert len(rows) == len(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    for r in rows:
        i = int(r["headers"]["x-page-id"])
        assert len(r["requests"]) == len(r["metadata"]) == 1
        assert r["payload_digest"] == "sha1:" + hashlib.sha1(html[i]).hexdigest()
        assert bytes(r["payload"]) == (b"" if i in (1, 2) else html[i])
        assert r["headers"].get("x-refers-to-page-id") == ("9" if i in (1, 2) else None)


def test_op1_repeated_and_missing_ids(spark, tmp_path):
    """Pages that share an id, or have none: each by its own payload."""
    a, b, c = "a" * 1500, "b" * 2500, "c" * 1200
    rows = [(1, "http://a/", a), (1, "http://b/", b), (1, "http://a/", a), (2, "http://c/", a), (None, "http://d/", b), (None, "http://d/", c),
            (None, None, c), (3, "http://e/", b), (3, "http://f/", b), (4, "http://g/", "short"), (None, "http://h/", "short"), (5, None, None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["n_requests"], r["n_metadata"])
                  for r in op1_warc_transactions(spark, str(tmp_path)).collect())
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        top = max((j for j, _, x in rows if x == h and j is not None), default=None) if len(h) >= 1000 else None
        again = top is not None and (i is None or i < top)
        want[i, len(h), hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", top if again else None, 1, 1] += 1
    assert got == want


def test_foreign_archive(spark):
    """Other writers: folded fields, members of their own, links from the capture, a cut tail."""
    def rec(kind, rid, body, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(body)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    parts = [rec("warcinfo", "<i>", b"software: x"), rec("response", "<r>", b"HTTP/1.1 200 OK\r\n\r\nhi", "WARC-Concurrent-To: <q>", "X-Long: a\r\n b"),
             rec("request", "<q>", b"GET /"), rec("metadata", "<m>", b"k: v", "WARC-Concurrent-To: <r>"), rec("metadata", "<lost>", b"k: v", "WARC-Concurrent-To: <none>"),
             rec("resource", "<s>", b"\x00\xff\xfe")]
    path = scratch(spark, "warc-foreign")
    rows = [(bytearray(b"".join(gzip.compress(p) for p in parts) + gzip.compress(rec("response", "<t>", b"cut off")[:-8])),)]
    out = spark._jvm.org.apache.hadoop.fs.Path(path + "/a.warc.gz")
    fs = out.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(out)
    stream.write(rows[0][0])
    stream.close()
    got = {r["record_id"]: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert set(got) == {"<r>", "<s>", "<t>"}
    assert [q["record_id"] for q in got["<r>"]["requests"]] == ["<q>"] and [m["record_id"] for m in got["<r>"]["metadata"]] == ["<m>"]
    assert got["<r>"]["headers"]["x-long"] == "a b" and bytes(got["<s>"]["block"]) == b"\x00\xff\xfe"
    assert got["<t>"]["truncated"] and not got["<s>"]["requests"]


def test_version_word_in_header(spark):
    """Urls with the version word, and fields of other writers with it."""
    word = "WARC/1.1 WARC/"
    rows = [(1, "http://x/WARC/a", "é" * 600), (2, "http://x/WARC/1.1", "é" * 600), (3, f"http://{word * 2000}", "see WARC/1.1\r\n\r\n"), (4, "http://y/", "WARC/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    for compression in ("gzip", "none"):
        got = {int(r["headers"]["x-page-id"]): r for r in warc.assemble(warc.read_records(spark, written(spark, pages, compression))).collect()}
        assert {i: r["target_uri"] for i, r in got.items()} == {i: u for i, u, _ in rows}
        assert all(len(r["requests"]) == len(r["metadata"]) == 1 and not r["truncated"] for r in got.values())
    path = scratch(spark, "warc-headers")
    text = ("WARC/1.0\r\nWARC-Type: warcinfo\r\nno end\r\n" "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nX-By: WARC/1.0\r\n"
            "Software: maker of WARC/ files\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(path)
    (row,) = warc.read_records(spark, path).where("type = 'resource'").collect()
    assert (row["record_id"], row["headers"]["software"], bytes(row["block"])) == ("<a>", "maker of WARC/ files", b"hi")


def test_split_archives(spark):
    """Uncompressed files over many input splits, with archives inside of payloads."""
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <no>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = spark.createDataFrame([(i, f"http://x/WARC/{i}", inner * i) for i in range(60)], "page_id bigint, url string, html string")
    path = written(spark, pages.coalesce(2), "none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "4099"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            records = warc.read_records(spark, path).collect()
            assert Counter(r["type"] for r in records) == {"request": 60, "metadata": 60, "response": 60}
            assert not any(r["truncated"] for r in records)
            got = {int(r["headers"]["x-page-id"]): bytes(r["block"]).split(b"\r\n\r\n", 1)[1] for r in records if r["type"] == "response"}
            assert got == {i: (inner * i).encode() for i in range(60)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_warc_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_records(spark, written(spark, none)).count() == 0


# --- quotes ------------------------------------------------------------------

def test_quotes_by_hand(spark):
    rows = [(1, 0, "Hello   all\n\nSecond part"), (1, 1, "A wrote:\n> hello all\n\nMy answer\nin two lines"),
            (1, 2, "> > Hello all\n> My answer in  two\n> lines\nno match"), (1, 3, "> My answer\n> in two lines\n\nFine."),
            (1, 4, "B said:\n>> second part\nreply to a nested quote"), (1, 5, "> written later\nx"), (1, 6, "written later"),
            (1, 7, None), (2, 0, "> Hello all\nother thread"), (2, 0, "> Hello all\nother thread"), (None, 1, "> q"), (3, None, "z"), (4, 0, "")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id bigint, turn bigint, text string, parent string")
    got = quotes.link(df).collect()
    assert len(got) == len(rows) and all(r["parent_"] == "p" for r in got)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    parents = {k: r["parent"] for k, r in by.items()}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 0, (1, 5): None, (1, 6): None, (1, 7): None, (2, 0): None,
                       (None, 1): None, (3, None): None, (4, 0): None}
    assert by[1, 1]["own_text"] == "My answer\nin two lines" and by[1, 3]["own_text"] == "Fine."
    assert [by[1, t]["depth"] for t in (0, 1, 2, 3, 4)] == [0, 1, 2, 2, 1]
    order = [t for _, t in sorted((by[1, t]["reply_order"], t) for t in range(8))]
    assert order == list(range(8)) and by[None, 1]["reply_order"] is None
    assert quotes.link(df.limit(0)).count() == 0


def test_partial_quotes(spark):
    """One line or sentence of a paragraph, answers between, and introductions inside of quotes."""
    first = "Can you send the report today? I also need\nthe list of names.\nAnd please call Bob at noon"
    rows = [(1, 0, first), (1, 1, "> And please call Bob at noon\nI did."), (1, 2, "> i also need the  list of names.\nHere it is."),
            (1, 3, "> Can you send the report today?\nYes.\n> I also need\n> the list of names.\nLater.\n> And please call Bob at noon\nDone."),
            (1, 4, "> Can you send the report tomorrow\nquotes nobody"), (1, 5, "> later line that is long\nx"), (1, 6, "later line that is long\ny"),
            (2, 0, "Hello all"), (2, 1, "Yes I do\nOn Monday, A wrote:\n> Hello all"),
            (2, 2, "> Yes I do\n> On Monday, A wrote:\n> > Hello all\n\nFine"),
            (2, 3, "> > Yes I do\n> > On Monday, A wrote:\n> > > Hello all\n> \n> Fine\nBye")]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")).collect()}
    assert {k: r["parent"] for k, r in got.items()} == {
        (1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 4): None, (1, 5): None, (1, 6): None, (2, 0): None, (2, 1): 0, (2, 2): 1, (2, 3): 2}
    assert (got[1, 3]["n_quoted"], got[1, 3]["n_linked"], got[1, 3]["own_text"]) == (3, 3, "Yes.\nLater.\nDone.")
    assert [(got[2, t]["n_quoted"], got[2, t]["n_linked"]) for t in (1, 2, 3)] == [(1, 1), (2, 2), (3, 3)]


def brute_links(rows):
    """{(thread, position): (own_text, parent, root, depth, reply_order, n_quoted, n_linked)} read message by message."""
    intro = re.compile(quotes.INTRODUCTION)
    squeeze = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")

    def read(text):
        lines = []
        for x in re.split("\r\n|\r|\n", text or ""):
            marks = re.match("[ \t>]*", x)[0]
            lines.append((marks.count(">"), x[len(marks):] if ">" in marks else x))
        deeper = [b[0] > a[0] and bool(intro.search(a[1])) for a, b in zip(lines, [*lines[1:], (0, "")])]
        own = "\n".join(b for (lv, b), d in zip(lines, deeper) if lv == 0 and not d).strip(" \t\n\x0b\f\r")
        parts, last = [], None
        for (lv, b), d in zip(lines, deeper):
            blank = not b.strip(" \t")
            if not blank and not d:
                if last == lv:
                    parts[-1][1].append(b)
                else:
                    parts.append((lv, [b]))
            last = None if blank else lv
        return own, [(lv, "\n".join(bs)) for lv, bs in parts if squeeze("\n".join(bs))]

    def unit_set(raw):
        us = [squeeze(x) for x in raw.split("\n")] + re.split(r"(?<=[.!?\u2026])[ \t\n\x0b\f\r]+", squeeze(raw))
        return {u for u in us if len(u) >= quotes.MIN_UNIT}

    texts = {}
    for t, p, x in rows:
        if t is not None and p is not None:
            texts[t, p] = x if (t, p) not in texts or texts[t, p] is None else texts[t, p] if x is None else min(x, texts[t, p])
    read_all = {k: read(x) for k, x in texts.items()}
    out = {}
    for t in {k[0] for k in texts}:
        at = sorted(p for u, p in texts if u == t)
        whole, part = {}, {}
        for p in at:
            for lv, raw in read_all[t, p][1]:
                if lv == 0:
                    whole.setdefault(squeeze(raw), p)
                    for u in unit_set(raw):
                        part.setdefault(u, p)
        parent, told = {}, {}
        for p in at:
            quoted, linked, votes = 0, 0, Counter()
            lost = defaultdict(set)
            for lv, raw in read_all[t, p][1]:
                lost[lv, squeeze(raw)] |= unit_set(raw)
            for lv, raw in read_all[t, p][1]:
                if lv == 0:
                    continue
                quoted += 1
                source = whole.get(squeeze(raw), p)
                if source >= p:
                    met = Counter(part[u] for u in lost[lv, squeeze(raw)] if part.get(u, p) < p)
                    source = max(met, key=lambda q: (met[q], q), default=None)
                if source is not None:
                    linked += 1
                    votes[-lv, source] += 1
            parent[p] = max(votes, key=lambda v: (v[0], votes[v], v[1]))[1] if votes else None
            told[p] = quoted, linked
        root, depth = {}, {}
        for p in at:
            root[p], depth[p] = (p, 0) if parent[p] is None else (root[parent[p]], depth[parent[p]] + 1)
        for i, p in enumerate(sorted(at, key=lambda p: (root[p], p))):
            out[t, p] = (parent[p], root[p], depth[p], i + 1, *told[p])
    return {(t, p): (read(x)[0], *out.get((t, p), (None,) * 6)) for t, p, x in rows}


@pytest.mark.parametrize("seed", range(3))
def test_quotes_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta. eta! theta? iota kappa Lambda".split()
    say = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 7)))
    rows = []
    for t in range(8):
        told = []
        for p in range(14):
            lines = []
            for _ in range(rng.randrange(1, 5)):
                if told and rng.random() < .6:
                    ls = rng.choice(told).split("\n")
                    a = rng.randrange(len(ls))
                    mark = rng.choice([">", "> ", ">> ", "> > "])
                    if rng.random() < .3:
                        lines.append(rng.choice(["", "> "]) + "On Monday, A wrote:")
                    lines += [mark + rng.choice([x, x, x.upper(), x + " "]) for x in ls[a:a + rng.randrange(1, 4)]]
                else:
                    lines += [say() for _ in range(rng.randrange(1, 4))]
                if rng.random() < .5:
                    lines.append(rng.choice(["", "  ", "> ", ">"]))
            told.append("\n".join(lines))
            rows.append((t, p, rng.choice(["\n", "\r\n"]).join(lines)))
    rows += [(1, 40, None), (2, 41, ""), (None, 1, "> alpha"), (3, None, "x\n> y")]
    want = brute_links(rows)
    got = {(r["conv_id"], r["turn"]): (r["own_text"], r["parent"], r["root"], r["depth"], r["reply_order"], r["n_quoted"], r["n_linked"])
           for r in quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").repartition(3)).collect()}
    wrong = [(k, rows[[(a, b) for a, b, _ in rows].index(k)][2], got[k], want[k]) for k in want if got[k] != want[k]]
    assert wrong == [], (len(wrong), wrong[:2])
    assert sum(w[1] is not None for w in want.values()) > 30


def test_long_chain_and_copies(spark):
    """A chain of 300 replies and a thread that repeats one text."""
    rows = [(1, i, f"message {i}") for i in range(300)] + [(2, i, "same text") for i in range(200)]
    got = quotes.link(quotes.quoting_thread(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string"))).collect()
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert all(by[1, i]["depth"] == i and by[1, i]["parent"] == (i - 1 if i else None) for i in range(300))
    assert all(by[1, i]["own_text"] == f"message {i}" and by[1, i]["reply_order"] == i + 1 for i in range(300))
    assert all(by[2, i]["parent"] == 0 for i in range(1, 200))  # the first to have written it


def test_quotes_stay_in_the_jvm(spark):
    rows = [(1, i, f"message {i}") for i in range(5)]
    df = quotes.link(quotes.quoting_thread(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


# --- pipeline ----------------------------------------------------------------

def test_pipeline_stages(spark):
    """Each stage on its own input, against brute force."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_copy", F.lit(1)).withColumn("shard_x", F.lit("e"))
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mixing_to_weights", "extendible_sharding"]
    good = stage["quality_classifier"](spark, base, sf)
    assert good.columns == base.columns and 0 < good.count() < base.count()

    kept = stage["simhash_near_dedup"](spark, base, sf)
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(base).collect()}
    assert kept.columns == base.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in prints.values()})

    clean = stage["benchmark_decontamination"](spark, base, sf)
    hit = {r["doc_id"] for r in decontam.digest(decontam.decontaminate(base, spark.read.parquet(f"{sf}/benchmark.parquet"))).where("contaminated").collect()}
    assert hit and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in base.collect()} - hit

    mixed = stage["mixing_to_weights"](spark, base, sf)
    n = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == base.columns and max(n.values()) <= 3 and max(n.values()) > 1

    last = stage["extendible_sharding"](spark, base, sf)
    assert last.count() == base.count() and {"shard", "oversize"} <= set(last.columns)
    assert cp.run(spark, sf).count() > 0


def test_pipeline_awkward_inputs(spark, tmp_path):
    import corpus_pipeline as cp

    for name, df in {"labels": spark.createDataFrame([(6, 1, 0), (11, 0, 0)], "doc_id bigint, quality int, toxic int"),
                     "benchmark": spark.createDataFrame([(1, "nothing of the kind is here at all or anywhere else")], "item_id bigint, text string")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (awkward_docs(spark), awkward_docs(spark, empty=True)):
        for name, f in cp.STAGES:
            out = f(spark, docs, str(tmp_path))
            rows = out.collect()
            if name == "simhash_near_dedup" and rows:
                ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
                assert len(ids) == len(set(ids))
            if name == "extendible_sharding":
                assert len(rows) == docs.count()
            else:
                assert out.columns == docs.columns


def test_pipeline_decides_per_row(spark, tmp_path):
    """Rows without an id, and rows with one id and different texts."""
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)
    window = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, window)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(None, f"{text(1)} {window}", "a"), (None, text(2), "a"), (None, text(2), "b"), (None, text(3), "b"),
            (7, f"{window} {text(4)}", "a"), (7, text(5), "a"), (7, text(5), "a"), (8, text(6), "b"), (7, text(6), "b"), (None, text(6), "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    clean = stage["benchmark_decontamination"](spark, docs, str(tmp_path)).collect()
    assert Counter(map(tuple, clean)) == Counter(r for r in rows if window not in r[1])

    kept = stage["simhash_near_dedup"](spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([
        (None, rows[0][1]), (None, text(2)), (None, text(3)), (7, rows[4][1]), (7, text(5)), (7, text(6))])

    # one source is taken three times, the other once in part; the budget is the number of words
    many = [(None if i % 2 else 1, f"{text(i)} {'y ' * (i % 7)}", "big" if i % 10 else "few") for i in range(200)]
    docs = spark.createDataFrame(many, "doc_id bigint, text string, source string")
    mixed = stage["mixing_to_weights"](spark, docs, str(tmp_path)).collect()
    n = Counter(r["text"] for r in mixed)
    assert set(n.values()) >= {1} and max(n.values()) <= 3 and len(n) < len(many)
    assert sum(len(r["text"].split()) for r in mixed) <= sum(len(t.split()) for _, t, _ in many)
