"""Compression classifier, PPM scoring and nearest neighbours."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from codepref.llm import ann, ppm, quality
from tests.llm.helpers import awkward_docs, crc, words

SF = "/root/testdata/sf0.1"


# --- quality -----------------------------------------------------------------

def test_quality_held_out(spark):
    """Accuracy on documents whose labels were not used."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    held = [(r["score"], r["quality"]) for r in rows if crc(r["doc_id"], 4) == 2]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.98
    assert sum(s >= 0.7 for s in good) / len(good) > 0.97
    assert sum(s < 0.7 for s in bad) / len(bad) > 0.9


def test_quality_learns_nothing_from_held_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert quality.training_sample(docs, labels) == quality.training_sample(docs, flipped)


def test_quality_features_and_calibration():
    """Sizes straight from the compressor; the weights are where the penalised
    likelihood has no slope."""
    rng = random.Random(4)
    text = lambda ws: " ".join(rng.choice(ws) for _ in range(rng.randrange(5, 90))).encode()
    sample = [(text(["alpha", "beta", "gamma delta"]), 1) for _ in range(150)] + [(text(["$$$", "buy now", "beta"]), 0) for _ in range(150)]
    model = quality.fit(sample, dict_bytes=4096)
    probe = [b"", b"x", *[t for t, _ in sample[140:160]]]
    got = quality._features(probe, model.coders())
    kind = zstandard.DICT_TYPE_AUTO if model.trained else zstandard.DICT_TYPE_RAWCONTENT
    for t, row in zip(probe, got):
        good, bad = (len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind)).compress(t))
                     for d in (model.good, model.bad))
        raw = len(t) + 16
        assert row == pytest.approx([(bad - good) / (bad + good), (bad - good) / raw, math.log(good / raw), math.log(bad / raw)])
    rest = [x for c in (0, 1) for i, x in enumerate(x for x in sample if x[1] == c) if i % 3 == 2]
    x, y = quality._features([t for t, _ in rest], model.coders()), np.array([c for _, c in rest], float)
    z = np.c_[np.ones(len(x)), (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)]
    w = np.array(model.weights)
    slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + 1e-3 * len(y) * np.r_[1e-6, np.ones(4)] * w
    assert np.abs(slope).max() < 1e-6
    assert model.score([t for t, _ in rest]) == pytest.approx(1 / (1 + np.exp(-z @ w)))


def test_quality_awkward(spark):
    docs = awkward_docs(spark)
    rows = [(i, i % 2, 0) for i in range(16)] + [(3, 1, 0), (4, None, 0), (None, 1, 0), (5, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for table in (labels, one, labels.limit(0)):
        got = quality.score(docs, quality.train(docs, table), "s").collect()
        assert len(got) == docs.count() and all(0 <= r["s"] <= 1 for r in got)
    assert {r["s"] for r in got} == {0.5}
    assert quality.score(awkward_docs(spark, empty=True), quality.train(docs, labels), "s").count() == 0


# --- PPM ---------------------------------------------------------------------

def brute_log10(train, data, order):
    """PPM with absolute discounting and exclusion, straight from counted contexts."""
    nodes = {}
    for d in train:
        padded = ppm.END * order + d
        for i in range(order, len(padded)):
            for k in range(order + 1):
                nodes.setdefault(padded[i - k:i], Counter())[padded[i]] += 1
    padded, out = ppm.END * order + data, 0.0
    for i in range(order, len(padded)):
        gone = set()
        for k in range(order, -1, -1):
            node = nodes.get(padded[i - k:i])
            if node is None:
                continue
            left = {b: n for b, n in node.items() if b not in gone}
            total = sum(left.values())
            if padded[i] in left:
                out += math.log10((left[padded[i]] - ppm.DISCOUNT) / total)
                break
            if total:
                out += math.log10(ppm.DISCOUNT * len(left) / total)
            gone |= set(node)
        else:
            out -= math.log10(256 - len(gone))
    return out


@pytest.mark.parametrize("order,limit,top", [(3, 10**6, 10**6), (4, 50, 5), (2, 50, 0)])
def test_ppm_matches_brute_force(spark, order, limit, top):
    """One slice or many, frequent words or none: the same scores."""
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["Aba", "cab", "über", "x", "banana", "ñu"]) for _ in range(rng.randrange(12))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (3, texts[3]), (None, "zzz new words"), (102, " \t ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    train = docs.where(~ppm.held_out())
    used = [t for i, t in rows if i is not None and crc(i, 7) != 2 or i is None]
    streams = [ppm.stream(t) for t in used]
    counts = Counter(w for t in used for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    got = ppm.score(docs, train, order=order, limit=limit, top=top).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        w = [*words(t), "\n"]
        want[i] = (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w),
                   brute_log10(streams, ppm.stream(t), order))
    for r in got:
        assert tuple(r)[1:4] == want[r["doc_id"]][:3]
        assert tuple(r)[4:] == pytest.approx(want[r["doc_id"]][3:], abs=1e-7)


def test_ppm_is_a_distribution():
    data = [b"abracadabra\n", b"abra banana band\n"]
    acc = [np.unique(k[v], return_counts=True) for _, _, k, v in ppm.pieces(data, 3)]
    keys, n = ppm._summed(*map(np.concatenate, zip(*acc)))
    trie = ppm.Trie.build(keys, n, *ppm._summed(keys & np.uint64(0xFFFF), n), 3)
    for ctx in (b"abr", b"\n\n\n", b"zzz", b"zza", b"ana", b"a b"):
        every = np.array([int.from_bytes(ctx, "big") << 8 | b for b in range(256)], dtype=np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1)


def test_ppm_long_texts_are_cut_without_loss(monkeypatch):
    s = [ppm.stream("lorem ipsum dolor " * 200), ppm.END, ppm.stream("a")]
    whole = Counter()
    for _, _, k, v in ppm.pieces(s, 4):
        whole.update(k[v].tolist())
    monkeypatch.setattr(ppm, "PIECE", 64)
    cut = Counter()
    for _, _, k, v in ppm.pieces(s, 4):
        cut.update(k[v].tolist())
    assert cut == whole and sum(whole.values()) == sum(map(len, s))


def test_ppm_beats_words_and_adapts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = ppm.score(docs, docs.where(~ppm.held_out())).where(ppm.held_out()).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    pair = spark.createDataFrame([(1, "ab" * 200), (2, "".join(random.Random(1).choices("abcdefgh", k=400))), (3, None)], "doc_id int, text string")
    s = {r["doc_id"]: r["s"] for r in ppm.adaptive_score(pair, 3, "s").collect()}
    assert s[3] == pytest.approx(-math.log10(256)) and 0 > s[1] > s[2]
    assert ppm.score(docs.limit(0), docs.limit(0)).count() == 0


# --- nearest neighbours ------------------------------------------------------

def brute_near(rows, k, asks):
    vecs = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    out = {}
    for a, q in enumerate(vecs):
        if asks(q[0]):
            found = sorted(((-(q[1] * v).sum(), i) for b, (i, v) in enumerate(vecs) if i != q[0]))
            out[q[0]] = [(i, -s) for s, i in found[:k]]
    return out


def test_ann_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(x) for x in rng.standard_normal(8) * (1 + i % 3)]) for i in range(120)]
    good += [(200 + i, good[0][1]) for i in range(60)]  # one vector held by many
    bad = [(500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (503, [1.0] * 7 + [None]), (504, [1.0]), (None, [1.0] * 8),
           (505, [float("inf")] * 8), (506, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id bigint, embedding array<float>, label int, rep string")
    got = ann.search(df, F.col("id") % 20 == 0, k=5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_near(good, 5, lambda i: i % 20 == 0)
    assert by.keys() == want.keys()
    for q in want:
        assert [i for i, _ in by[q]] == [i for i, _ in want[q]]
        assert [s for _, s in by[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)
    few = ann.search(df.where("vec_id < 4"), F.col("id") == 0, k=20).collect()
    assert len(few) == 3
    assert ann.search(df.limit(0), F.col("id") == 0).count() == 0


def test_ann_doubles(spark):
    """Vectors in double precision keep it, far beyond the range of single precision."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 6)) * 10.0 ** rng.integers(-3, 4, (300, 1))
    x[5] *= 1e39
    x[7] = [1e300, 0, 0, 0, 0, 1e300]
    x[9] = [float("inf")] * 6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 15
    met = 0
    for q, rows in got.items():
        want = sorted(((-math.fsum(x[q] * x[i]), i) for i in range(300) if i not in (q, 9)))[:5]
        for _, i, s in rows:
            assert s == pytest.approx(float((x[i] * x[q]).sum()), rel=1e-12) and i != 9
        met += len({i for _, i in want} & {i for _, i, _ in rows})
        assert {7, 5} & {i for _, i in want} <= {i for _, i, _ in rows}
    assert met >= 0.9 * 75


def test_ann_repeated_ids(spark):
    """Copies of a row, ids with several vectors, and an id that holds most vectors."""
    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in rng.standard_normal(6).astype(np.float32)]
    one, big = vec(), 20 + 2 ** 60
    rows = [(i, vec()) for i in range(100)]
    rows += [(0, rows[0][1])] * 40 + [(20, rows[20][1])] + [(3, rows[3][1])] * 30  # stored again
    rows += [(40, vec()) for _ in range(12)] + [(5, vec()) for _ in range(3)] + [(big, vec()) for _ in range(300)]
    rows += [(i, one) for i in (40, 60, 60, 80, 101, 102, 103)] + [(big, one)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    for k in (5, 20):
        want = Counter()
        for i, v in distinct:
            if i in (0, 20, 40, 60, 80, big):
                found = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in distinct if j != i)[:k]
                want.update((i, n + 1, j, round(-s, 6)) for n, (s, j) in enumerate(found))
        got = ann.search(df, F.col("id").isin(0, 20, 40, 60, 80, big), k=k).collect()
        assert Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got) == want


def test_ann_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_near(rows, 20, lambda i: i % 100 == 0)
    got = {}
    for r in ann.search(df, F.col("id") % 100 == 0, k=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.9


def test_adaptive_scan_keeps_the_near(spark):
    """The tests abandon most of a cell and almost none of the true neighbours."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64)).astype(np.float32) @ ann.rotation(64)
    q = x[:50]
    d = ann.distances(q, x)
    bound = np.partition(d, 20, axis=1)[:, 20]
    at, row = ann.scan(x, q, bound)
    kept = set(zip(at.tolist(), row.tolist()))
    near = [(i, j) for i in range(50) for j in np.flatnonzero(d[i] <= bound[i])]
    assert sum(p in kept for p in near) / len(near) > 0.98 and len(kept) < 0.1 * 50 * 4000
