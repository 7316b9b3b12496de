"""SimHash, positional index, mixing, sharding, line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from codepref.llm import decontam, linedup, mixing, sharding, simhash
from codepref.llm.common import components, materialize, running_total
from tests.llm.helpers import awkward_docs, words
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


def sf_docs(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- helpers -----------------------------------------------------------------

def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    want = helpers.components(nodes, [p for p in pairs if p[0] != p[1]])
    assert got == want


def test_running_total_hot_group(spark):
    rows = [(0 if i % 3 else 1, (i * 7919) % 1000, i, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, o int, u int, v bigint")
    got = {r["u"]: r["t"] for r in running_total(df, ["g"], ["o", "u"], "v", "t").collect()}
    want, sums = {}, Counter()
    for g, o, u, v in sorted(rows):
        sums[g] += v
        want[u] = sums[g]
    assert got == want


# --- SimHash -----------------------------------------------------------------

def brute_print(text, k=3):
    w = words(text)
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("radius,parts", [(0, 1), (2, 2), (3, 2), (5, 3)])
def test_links_find_every_pair(spark, radius, parts):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    vals = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)}
    vals = sorted(v - (1 << 64) if v >> 63 else v for v in vals)
    got = sorted(map(tuple, simhash.links(spark.createDataFrame([(v,) for v in vals], "fp bigint"), radius, parts).collect()))
    want = [(a, b) for a, b in combinations(vals, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    assert got == want and len(set(got)) == len(got)


@pytest.mark.parametrize("source", ["awkward", "sf"])
def test_near_duplicates(spark, docs, source):
    d = docs if source == "awkward" else sf_docs(spark)
    rows = [(r["doc_id"], brute_print(r["text"])) for r in d.collect()]
    prints = {f for _, f in rows}
    comp = helpers.components(prints, [(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    least = {}
    for i, f in rows:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = Counter((i, f, least.get(comp[f])) for i, f in rows)
    got = Counter((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(d).collect())
    assert got == want


def test_simhash_empty(spark):
    assert simhash.near_duplicates(awkward_docs(spark, empty=True)).count() == 0


# --- positional index --------------------------------------------------------

WORDS5 = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def w5(t):
    return WORDS5.findall(helpers.lower(t))


def brute_hits(rows, items, size):
    out = []
    for i, text in rows:
        w, hit, found = w5(text), set(), set()
        for item, t in items:
            iw = w5(t) if t is not None else []
            n = min(size, len(iw))
            wins = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p:p + n]) in wins and item is not None:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


ITEMS = [(1, "quick brown fox jumps over"), (2, None), (3, ""), (4, "one"), (5, "The Lazy dog, and runs far away from here today a wholly"),
         (10, "rivers mountains and"), (1, "long road"), (None, "sentence about"), (7, "!!!")]


@pytest.mark.parametrize("size,block", [(10, 1 << 20), (3, 1 << 20), (4, 40)])
def test_decontaminate(spark, docs, size, block):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = Counter(map(tuple, decontam.digest(decontam.decontaminate(docs, bench, size, block_bytes=block)).collect()))
    assert got == brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, size)


def test_decontaminate_sf(spark):
    items = [tuple(r) for r in sf_docs(spark, "benchmark").select("item_id", "text").collect()]
    d = sf_docs(spark)
    got = Counter(map(tuple, decontam.digest(decontam.decontaminate(d, sf_docs(spark, "benchmark"))).collect()))
    want = brute_hits([(r["doc_id"], r["text"]) for r in d.collect()], items, 10)
    assert got == want and any(r[5] for r in want) and not all(r[5] for r in want)


def test_blocks_do_not_join_documents(spark):
    """A phrase across two documents of a block is no match."""
    d = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "a b c d e f")], "doc_id bigint, text string").coalesce(1)
    b = spark.createDataFrame([(9, "c d")], "item_id bigint, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.digest(decontam.decontaminate(d, b)).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma beta alpha"), (4, "alpha x x x x beta gamma")],
                              "doc_id bigint, text string")
    b = spark.createDataFrame([(9, "alpha beta gamma")], "item_id bigint, text string")
    got = {r["doc_id"]: [(m["start"], m["length"], m["exact"]) for m in r["matches"]] for r in decontam.decontaminate(d, b, slack=1).collect()}
    assert got[1] == [(0, 4, False)] and got[4] == []
    assert sorted(got[2]) == [(0, 3, False), (0, 3, True)]


def test_decontaminate_empty(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert not decontam.digest(decontam.decontaminate(docs, none)).where("contaminated").count()
    assert decontam.decontaminate(awkward_docs(spark, empty=True), bench).count() == 0


# --- mixing ------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        space = sum(w[s] for s in names if s not in full)
        out = {s: cap * sizes[s] if s in full else left * w[s] / space for s in names}
        over = {s for s in names if s not in full and out[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("source", ["awkward", "sf", "lopsided"])
def test_mix(spark, docs, source):
    if source == "lopsided":
        rows = [(i, "w " * (1 + i % 9), "big" if i % 50 else ["a", "b", "c", "d"][i // 50 % 4]) for i in range(1500)]
        d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    else:
        d = docs if source == "awkward" else sf_docs(spark)
    sizes = Counter()
    for r in d.collect():
        sizes[r["source"]] += len(helpers.WORD.findall(r["text"] or ""))
    want = brute_targets(sizes)
    got = mixing.mix(d).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in d.collect())
    by_id = {r["doc_id"]: r["source"] for r in d.collect()}
    taken, biggest = Counter(), Counter()
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
        biggest[s] = max(biggest[s], r["size"])
    assert sum(taken.values()) <= sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(biggest.values()) + 1, s
    again = Counter(map(tuple, mixing.mix(d.repartition(5)).collect()))
    assert again == Counter(map(tuple, got))


def test_mix_does_not_depend_on_files(spark):
    rng = random.Random(2)
    rows = [(None if i % 2 else i // 6, " ".join(["w"] * rng.randrange(30) + [f"x{rng.randrange(400)}"]), rng.choice(["a", "a", "b", None])) for i in range(700)]
    taken = []
    for order, files in ((1, 1), (2, 7)):
        random.Random(order).shuffle(rows)
        d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(files)
        d = materialize(d.withColumn("nr", F.monotonically_increasing_id()))
        got = mixing.mix(d, row="nr").select("nr", "taken", "copies")
        taken.append(Counter(tuple(r)[1:] for r in d.join(got, "nr").collect()))
    assert taken[0] == taken[1]


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(awkward_docs(spark, empty=True)).count() == 0
    d = spark.createDataFrame([(1, None, "a"), (2, "  ", None)], "doc_id bigint, text string, source string")
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix(d).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


# --- sharding ----------------------------------------------------------------

def brute_shards(rows, limit):
    """The textbook way: one bucket at depth 0, split while over the limit."""
    h = lambda i: bin(int(hashlib.md5(f"{'' if i is None else i}:shard".encode()).hexdigest()[:15], 16))[2:].zfill(60)
    out, todo = {}, [("", [(h(i), i, n) for i, n in rows])]
    while todo:
        prefix, held = todo.pop()
        if sum(n for _, _, n in held) <= limit or len(prefix) == 60:
            for x, i, n in held:
                out[i] = "b" + prefix
        else:
            for bit in "01":
                todo.append((prefix + bit, [x for x in held if x[0][len(prefix)] == bit]))
    return out


@pytest.mark.parametrize("limit", [200, 3000, 20_000, 10**9])
def test_shards(spark, limit):
    rows = [(i, "é" * (i * 37 % 400), "x") for i in range(600)] + [(1000, "z" * 5000, "x"), (1001, None, "x"), (None, "q", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = sharding.shard(d, limit).collect()
    size = lambda t: len((t or "").encode())
    assert {r["doc_id"]: r["shard"] for r in got} == brute_shards([(i, size(t)) for i, t, _ in rows], limit)
    assert len(got) == len(rows) and all(r["shard_"] == "x" for r in got)
    held = defaultdict(list)
    for r in got:
        held[r["shard"], r["shard_page"]].append((size(r["text"]), r["oversize"]))
    for v in held.values():
        assert sum(n for n, _ in v) <= limit or (len(v) == 1 and v[0][1])


def test_shard_hot_key_pages(spark, docs):
    rows = [(1, "abcdefghij")] * 500 + [(1, "other text")] * 3 + [(i, "ab") for i in range(2, 300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.shard(d, 100).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    held = Counter()
    for r in got:
        held[r["shard"], r["shard_page"]] += len(r["text"])
    assert max(held.values()) <= 100
    various = [(7, "y" * (i * 13 % 47) + f"{i:03}") for i in range(200)] * 2 + [(7, "z" * n) for n in (60, 80, 100, 130)] + [(7, None)] + [(8, "q" * 40 + str(i)) for i in range(9)]
    got = sharding.shard(spark.createDataFrame(various, "doc_id bigint, text string"), 100).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(various)
    held, key = defaultdict(list), {}
    for r in got:
        held[r["shard"], r["shard_page"]].append(len(r["text"] or ""))
        key[r["shard"], r["shard_page"]] = r["doc_id"]
        assert r["oversize"] == (len(r["text"] or "") > 100)
    assert all(sum(v) <= 100 or len(v) == 1 for v in held.values())
    for k in (7, 8):
        assert sum(x == k for x in key.values()) <= 2 * sum(len(t or "") for i, t in various if i == k) / 100 + 2
    assert sharding.shard(awkward_docs(spark, empty=True)).count() == 0
    assert sharding.shard(docs, 1000).count() == docs.count()


# --- lines -------------------------------------------------------------------

def brute_lines(rows, p=4, q=5):
    """Each row by itself; rows stand in the order of id and text digest."""
    def place(i, t):
        digest = xxhash.xxh64_intdigest(t.encode(), 42)
        return (i is not None, i if i is not None else 0, digest - (1 << 64) if digest >> 63 else digest)

    lines = [((*place(i, t), k), frozenset(w)) for i, t in set(rows) if t is not None
             for k, x in enumerate(t.split("\n")) if (w := helpers.WORD.findall(x))]
    first = {}
    for at, s in lines:
        first[s] = min(at, first.get(s, at))
    near = defaultdict(list)
    for a, b in combinations(first, 2):
        if q * len(a & b) >= p * len(a | b):
            near[a].append(b)
            near[b].append(a)
    removed = defaultdict(list)
    count = Counter()
    for at, s in lines:
        count[at[:3]] += len(near[s])
        if first[s] < at or any(first[o] < first[s] for o in near[s]):
            removed[at[:3]].append(at[3])
    out = Counter()
    for i, t in rows:
        r = [] if t is None else sorted(removed[place(i, t)])
        out[i, 0 if t is None else len(t.split("\n")), tuple(r), len(r), 0 if t is None else count[place(i, t)]] += 1
    return out


def line_tables(spark, docs):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    bases = [rng.sample(vocab, rng.randrange(1, 25)) for _ in range(25)]
    out = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(bases))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text.append(" ".join(w) if rng.random() > .1 else rng.choice(["", "  ", "\t"]))
        out.append((i, "\n".join(text)))
    base = [f"v{i}" for i in range(45)]
    near = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(45)] = f"n{rng.randrange(200)}"
        near.append((i, " ".join(w)))
    return {"near": spark.createDataFrame(near, "doc_id bigint, text string"), "awkward": docs.select("doc_id", "text"),
            "shared": spark.createDataFrame([(None if i % 3 == 0 else i % 7, t) for i, t in out * 2], "doc_id bigint, text string"), "random": spark.createDataFrame(out, "doc_id bigint, text string"),
            "sf": sf_docs(spark).select("doc_id", "text")}


@pytest.mark.parametrize("source", ["awkward", "random", "shared", "near", "sf"])
def test_lines(spark, docs, source):
    d = line_tables(spark, docs)[source]
    want = brute_lines([tuple(r) for r in d.collect()])
    got = Counter((r["doc_id"], r["n_lines"], tuple(r["removed_lines"]), r["n_removed"], r["n_links"]) for r in linedup.summary(d).collect())
    assert got == want
    assert any(r[3] for r in want)


def test_line_dedup_texts(spark):
    d = spark.createDataFrame([(1, "a b c d e\nkeep me", "k"), (2, "x\na b c d e\ny z", "k"), (3, None, "k")], "doc_id bigint, text string, _cut string")
    got = {r["doc_id"]: r["text"] for r in linedup.dedup(d).collect()}
    assert got == {1: "a b c d e\nkeep me", 2: "x\ny z", 3: None}
    assert linedup.summary(d.limit(0)).count() == 0
    same = [(1, "same words in this line\nfirst"), (2, "same words in this line\nsecond"), (2, "a totally different text\nthird one"),
            (None, "no id at all here"), (None, "other\nno id at all here")]
    got = Counter(r["text"] for r in linedup.dedup(spark.createDataFrame(same, "doc_id bigint, text string")).collect())
    assert got[same[0][1]] == got["second"] == got[same[2][1]] == 1 and sum(t.count("no id at all here") for t in got) == 1


def test_line_candidates_are_near(spark):
    """Long sets that share many words without being similar make few candidates (2003 by two separate parities), and
    each line is hashed once, where its row is made."""
    rng = random.Random(8)
    pool = [f"p{i}" for i in range(135)]
    d = spark.createDataFrame([(i, " ".join(rng.sample(pool, 110))) for i in range(80)], "doc_id bigint, text string")
    lines = linedup.keyed_lines(d, linedup.rarity_key(d), linedup.SIMILARITY)
    assert lines.count() == 80
    assert linedup.candidates(lines, linedup.SIMILARITY).count() < 600
    plan = linedup.word_sets(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1
    joined = linedup.summary(d)._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "AS text_id" in joined.splitlines()[1]  # the texts stay out of the join


def test_line_groups_are_counted(spark):
    """Pairs of a group of near copies are counted and not written (before: each of them), also where groups are
    near each other and their sets differ in much or in the same words."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    bases = [base, base[:54] + [f"c{i}" for i in range(6)], base[:30] + [f"d{i}" for i in range(30)]]
    rows = []
    for i in range(420):
        w = list(bases[i % 7 // 3])
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 8])):
            w[rng.randrange(60)] = f"m{rng.randrange(9)}" if rng.random() < .3 else f"u{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w[:rng.choice([60, 60, 57])]) + rng.choice(["", "\nb1 b2"])))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_lines"], tuple(r["removed_lines"]), r["n_removed"], r["n_links"]) for r in linedup.summary(d).collect())
    assert got == brute_lines(rows)
    links, counted = linedup.class_links(d)[2:4]
    written, told = links.count(), counted.agg({"n_links": "sum"}).head()[0]
    assert links.distinct().count() == written
    assert told > 3 * written  # each counted pair twice


def test_native_plans(spark, docs):
    """The native operators run no Python on their plans."""
    for df in (sharding.shard(docs, 1000), linedup.summary(docs.select("doc_id", "text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
