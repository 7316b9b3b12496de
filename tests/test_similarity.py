"""N-gram overlaps, subsequences, corpus scores and pair fits against plain forms."""

import hashlib
import json
import math
import random
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codepref.operators import embed as em
from codepref.operators import evaluate as ev


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
        row = new
    return row[-1]


words = st.lists(st.sampled_from("abcde"), max_size=70)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_subsequence_and_overlaps(a, b):
    assert ev.common_subsequence(a, b) == table_lcs(a, b)
    grams = lambda t, n: Counter(zip(*(t[i:] for i in range(n))))
    got = ev._overlaps_of([a, b, [], a], [b, a, a, a], 4).tolist()
    for n in range(4):
        shared = sum((grams(a, n + 1) & grams(b, n + 1)).values())
        assert [g[n] for g in got] == [shared, shared, 0, max(0, len(a) - n)]


def test_long_subsequence():
    rnd = random.Random(3)
    a = [str(rnd.randrange(300)) for _ in range(20_000)]
    assert ev.common_subsequence(a, a[::2]) == 10_000


def test_rouge_l_rows(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat on the mat sat"), (2, None, "a"), (3, "", ""), (4, "x y", "y x")], "k int, c string, r string")
    got = {r["k"]: (r["lcs"], r["recall"], r["precision"], r["f1"]) for r in ev.rouge_l(df, ["k"], "c", "r").collect()}
    assert got == {1: (3, 0.5, 1.0, round(2 / 3, 9)), 2: (0, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0), 4: (1, 0.5, 0.5, 0.5)}


def test_corpus_bleu_is_not_a_mean(spark):
    pairs = [("a b c d e", "a b c d e"), ("a b c d x y", "a b c d z"), ("q", "r s")]
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(pairs)], "k int, c string, r string")
    got = ev.corpus_bleu(ev.ngram_overlap(df, ["k"], "c", "r")).first()
    p = []
    for n in range(1, 5):
        grams = [[Counter(zip(*(t.split()[i:] for i in range(n)))) for t in pair] for pair in pairs]
        p.append(sum(sum((c & r).values()) for c, r in grams) / sum(sum(c.values()) for c, _ in grams))
    want = math.exp(sum(map(math.log, p)) / 4) * min(1.0, math.exp(1 - 12 / 12))
    assert (got["cand_tokens"], got["ref_tokens"]) == (12, 12) and abs(got["bleu"] - want) < 1e-8


def test_nested_json(spark):
    rnd = random.Random(5)
    numbers = [0.0, -0.0, 1.0, 0.1, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, -2.5e-7, 1.5e300, 1e22, float("inf"), float("-inf")]
    numbers += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-30, 30) for _ in range(300)]
    rows = [(i, x, {"z": {"b": [x, None], "a": 'q"\\\né\U0001f642'}, "m": {"k2": i, "é": None, "K": 3}, "t": i % 2 == 0, "e": []}) for i, x in enumerate(numbers)]
    schema = "i bigint, x double, d struct<z:struct<b:array<double>,a:string>,m:map<string,bigint>,t:boolean,e:array<bigint>>"
    df = spark.createDataFrame(rows, schema)
    got = {r["i"]: r for r in df.select("i", ev.canonical_json(F.struct("x", "d"), df.select(F.struct("x", "d").alias("s")).schema["s"].dataType).alias("j"),
                                        ev.fingerprint_rows(df, "d", "x").alias("f")).collect()}
    for i, x, d in rows:
        want = json.dumps({"x": x, "d": d}, sort_keys=True)
        assert got[i]["j"] == want
        assert got[i]["f"] == hashlib.md5(want.encode()).hexdigest()


def test_pair_fit_steps(spark):
    rnd = random.Random(1)
    pairs = [([rnd.gauss(0, 1) for _ in range(5)], [rnd.gauss(0, 1) for _ in range(5)], i % 2) for i in range(60)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, y int")
    w = [0.0] * 5
    for _ in range(4):
        g = [0.0] * 5
        for a, b, y in pairs:
            d = [p - q for p, q in zip(a, b)]
            e = y - 1 / (1 + math.exp(-sum(p * q for p, q in zip(d, w))))
            g = [p + e * q for p, q in zip(g, d)]
        w = [p + 0.5 * q / len(pairs) for p, q in zip(w, g)]
    got = {r["idx"]: r["weight"] for r in em.descend_pair_scorer(df, steps=4, rate=0.5).collect()}
    assert all(abs(got[i] - x) < 1e-12 for i, x in enumerate(w)) and len(got) == 5
    assert em.descend_pair_scorer(df.limit(0)).count() == 0


def test_overlaps_counted_once_per_row(spark):
    """A filter on the overlaps must not be pushed below them: cut and counted twice."""
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, None, "a"), (3, "", ""), (4, "x y", None)], "k int, c string, r string")
    d = ev.sentence_bleu(df, ["k"], "c", "r")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r["k"]: r["bleu"] for r in d.collect()} == {1: 1.0, 2: 0.0, 4: 0.0}


def test_overlaps_keep_little_in_python(spark):
    """Tokens stay in Arrow's arrays: counting two texts of 2 MB takes less than 100 MB of Python's own objects."""
    import tracemalloc

    rnd = random.Random(5)
    texts = [ev._SEP.join(str(rnd.randrange(5000)) for _ in range(400_000)) for _ in range(2)]
    cand, ref = (pa.array([t, None, "", "a"]) for t in texts)
    tracemalloc.start()
    got = ev._overlaps_of(ev._token_lists(cand), ev._token_lists(ref), 2)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    a, b = (Counter(t.split(ev._SEP)) for t in texts)
    assert got[0, 0] == sum((a & b).values()) and got[1:].tolist() == [[0, 0], [0, 0], [1, 0]]
    assert most < 100 << 20


def test_slices_bound_bytes():
    cand, ref = pa.array(["a" * 400, None, "b" * 400, "c" * 3000, "", "d"]), pa.array(["", "x" * 500, None, "", "", "y"])
    parts = list(ev._slices(cand, ref, size=1000))
    assert [i for p in parts for i in range(len(cand))[p]] == list(range(len(cand)))
    n_bytes = [len(a or "") + len(b or "") for a, b in zip(cand.to_pylist(), ref.to_pylist())]
    assert len(parts) > 2 and all(sum(n_bytes[p][1:]) < 1000 for p in parts)


def test_token_lists_of_slices():
    """Slices of a batch, as the counter takes them (Arrow's if_else, say, goes wrong on these)."""
    rnd = random.Random(2)
    texts = [rnd.choice([None, "", ev._SEP.join(rnd.choice("abc") * rnd.randrange(4) for _ in range(rnd.randint(1, 30)))]) for _ in range(300)]
    batch = pa.array(texts)
    for a in range(0, 290, 7):
        for b in (a + 1, a + 5, a + 100):
            assert ev._token_lists(batch[a:b]).to_pylist() == [t.split(ev._SEP) if t else [] for t in texts[a:b]]


def test_overlaps_of_many_slices(spark):
    """Batches of several slices, with nulls and empty texts, against plain counts."""
    rnd = random.Random(4)
    text = lambda: rnd.choice([None, "", " ".join(str(rnd.randrange(60)) for _ in range(rnd.randrange(9000)))])
    pairs = [(i, text(), text()) for i in range(300)]
    df = spark.createDataFrame(pairs, "k int, c string, r string").coalesce(1)
    got = {(r["k"], r["n"]): (r["matches"], r["cand_total"], r["ref_total"]) for r in ev.ngram_overlap(df, ["k"], "c", "r", 3).collect()}
    want = {}
    for k, c, r in pairs:
        for n in (1, 2, 3):
            x, y = (Counter(zip(*((t or "").split()[i:] for i in range(n)))) for t in (c, r))
            if x or y:
                want[k, n] = (sum((x & y).values()), x.total(), y.total())
    assert got == want
