"""Properties of the quota, splits, corruption and preference builders."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codepref.functions.text import seeded_hash
from codepref.operators.corrupt import with_corruption
from codepref.operators.evaluate import pass_at_k
from codepref.operators.preference import build_dpo, build_kto, dpo_quota, kto_quota, label_predictions
from codepref.operators.sampling import assign_split, hash_quota, skip_first, take_first
from codepref.sources.fixtures import view
from codepref.sources.tables import read_table
from tests.conftest import SF_MID, SF_SMALL


def _ids(df, key="doc_id"):
    return sorted(r[key] for r in df.select(key).collect())


@pytest.mark.parametrize("k", [0, 1, 37, 200, 5000])
def test_hash_quota_equals_window(spark, k):
    d = read_table(spark, SF_MID, "documents").select("doc_id", "lang")
    w = Window.partitionBy("lang").orderBy(seeded_hash("doc_id", 3), "doc_id")
    expected = d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    got = hash_quota(d, k, ["lang"], key="doc_id", seed=3)
    assert _ids(got) == _ids(expected)
    n = d.groupBy("lang").count().collect()
    assert got.count() == sum(min(k, r["count"]) for r in n)


def test_hash_quota_partitioning_invariant(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id", "lang")
    a = _ids(hash_quota(d, 77, ["lang"], key="doc_id", seed=5))
    b = _ids(hash_quota(d.repartition(13), 77, ["lang"], key="doc_id", seed=5))
    c = _ids(hash_quota(d.coalesce(1), 77, ["lang"], key="doc_id", seed=5, bits=4))
    assert a == b == c


def test_take_skip_complement(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id")
    t, s = _ids(take_first(d, 123, key="doc_id")), _ids(skip_first(d, 123, key="doc_id"))
    assert len(t) == 123 and not set(t) & set(s) and sorted(t + s) == _ids(d)


def test_exact_split_sizes(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id", "lang")
    s = assign_split(d, key="doc_id", exact=True, groups=["lang"])
    assert _ids(s) == _ids(d)
    for r in s.groupBy("lang").pivot("split", ["test", "validation", "train"]).count().collect():
        n = r["test"] + r["validation"] + r["train"]
        assert r["test"] == math.ceil(0.15 * n - 1e-9)
        assert r["validation"] == math.ceil(0.11 * (n - r["test"]) - 1e-9)


def test_hash_split_stable(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id")
    small = {r["doc_id"]: r["split"] for r in assign_split(d.where("doc_id < 300"), key="doc_id").collect()}
    full = {r["doc_id"]: r["split"] for r in assign_split(d, key="doc_id").collect()}
    assert all(full[k] == v for k, v in small.items())


def test_corruption_changes_exactly_one_line(spark):
    lab = label_predictions(view(spark, SF_MID, "code_base")).where("valid AND code <> ''")
    out = with_corruption(lab, seed=4).select("code", "corrupted").collect()
    assert out
    for r in out:
        assert r["corrupted"] is not None and r["corrupted"] != r["code"]
        a, b = r["code"].split("\n"), r["corrupted"].split("\n")
        assert len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def test_corruption_edge_cases(spark):
    df = spark.createDataFrame([(1, "", "java"), (2, "// only a comment (", "java"), (3, "# x = (1)", "python"),
                                (4, "    return x", "python")], "row_id long, code string, language string")
    got = {r["row_id"]: r["corrupted"] for r in with_corruption(df).collect()}
    assert got[1] == "" and got[2] is None and got[3] is None
    assert got[4] != "    return x" and got[4] is not None


def test_kto_size_property(spark):
    base = view(spark, SF_SMALL, "code_base")
    kto = build_kto(base, 0.5, seed=1)
    flagged = label_predictions(base)
    c = flagged.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("neg"),
                                         F.count_if("candidate").alias("cand")).collect()
    expected = sum(r["n"] + r["neg"] + min(r["cand"], max(0, r["n"] - r["neg"])) for r in c)
    assert kto.count() == expected
    assert kto.where("label").count() == sum(r["n"] for r in c)


def test_dpo_clamps(spark):
    base = view(spark, SF_SMALL, "code_base")
    flagged = label_predictions(base)
    neg = flagged.where("NOT valid").count()
    dpo = build_dpo(base, 0.0, seed=1)
    assert dpo.count() == neg
    assert dpo.where("rejected IS NULL").count() == 0


def test_quota_formulas(spark):
    c = spark.createDataFrame([(1000, 600, 300), (1000, 100, 900), (10, 0, 10)], "n long, neg long, candidates long")
    k = [r["k"] for r in kto_quota(c, 0.5).collect()]
    assert k == [400, 900, 10]
    assert [r["k"] for r in kto_quota(c, 0.0).collect()] == [0, 0, 0]
    assert [r["k"] for r in kto_quota(c, 0.9).collect()] == [8400, 8900, 90]
    assert [r["k"] for r in dpo_quota(c, 0.5).collect()] == [0, 400, 5]
    assert [r["k"] for r in dpo_quota(c, 0.5, compat=True).collect()] == [200, 400, 5]
    with pytest.raises(ValueError):
        kto_quota(c, 1.0)


def test_pass_at_k_golden(spark):
    rows = [(0, False)] * 5 + [(1, True)] * 5 + [(2, True)] * 2 + [(2, False)] * 3 + [(3, True), (3, False)]
    df = spark.createDataFrame(rows, "task_id int, passed boolean")
    got = {r["task_id"]: r for r in pass_at_k(df, (1, 2)).collect()}
    assert got[0]["pass_at_1"] == 0.0 and got[1]["pass_at_1"] == 1.0
    assert got[2]["pass_at_1"] == pytest.approx(0.4)
    assert got[2]["pass_at_2"] == pytest.approx(1 - math.comb(3, 2) / math.comb(5, 2))
    assert got[3]["pass_at_2"] == 1.0


def test_hot_group_spreads_over_buckets(spark):
    """One language holds about half the documents; the quota's row-number
    windows run per (group, hash bucket), so no window partition gets more
    than a sliver of that group."""
    d = read_table(spark, SF_MID, "documents").select("doc_id", "lang")
    sizes = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    hot = max(sizes, key=sizes.get)
    assert sizes[hot] * 3 >= sum(sizes.values())  # a third or more of all rows
    b = d.withColumn("_b", F.shiftright(seeded_hash("doc_id", 0), 16))
    largest = b.where(F.col("lang") == hot).groupBy("_b").count().agg(F.max("count")).first()[0]
    assert largest <= max(3, sizes[hot] // 100)


def test_java_brace_repair_keeps_java_rows(spark):
    """Q3: N2 drops the "{" from the Java def; the validity check puts it back,
    so normalised Java references are not all rejected (compat keeps the bug)."""
    from codepref.operators.filters import filter_seed
    from codepref.operators.normalize import normalize_seed

    seed = normalize_seed(view(spark, SF_MID, "code_raw"))
    assert filter_seed(seed).where("language = 'java'").count() > 0
    # without it only bodies that lack their closing brace too are "balanced"
    literal = filter_seed(seed, compat=True).where("language = 'java'").select("row_id", "code_completion").collect()
    assert all(not r["code_completion"].rstrip().endswith("}") for r in literal)
    repaired = {r["row_id"] for r in filter_seed(seed).where("language = 'java'").select("row_id").collect()}
    assert not repaired & {r["row_id"] for r in literal}


def test_flagship_steps_on_very_long_rows(spark):
    """Labelling and corruption stay flat on one 50,000-line prediction."""
    body = "    x = x + 1\n" * 50000
    rows = [(1, "python", "def f(x):", "def f(x):", "    return x", "def f(x):\n" + body + "    return x\nprint()"),
            (2, "java", "int f(int x) {", "int f(int x) {", "    return x;\n}",
             "int f(int x) {\n" + body.replace("+ 1", "+ 1;") + "    return x;\n}\nrest"),
            (3, "kotlin", "fun f(x: Int): Int {", "fun f(x: Int): Int {", "    return x\n}",
             "fun f(x: Int): Int {\n" + body + "    return x\n}")]
    base = spark.createDataFrame(rows, "row_id long, language string, prompt string, function_def string, "
                                       "code_completion string, prediction string")
    lab = label_predictions(base)
    out = with_corruption(lab, seed=3).select("row_id", "valid", "candidate", F.length("code").alias("n"),
                                              (F.col("corrupted") != F.col("code")).alias("changed")).collect()
    got = {r["row_id"]: r for r in out}
    assert all(r["valid"] and r["candidate"] and r["changed"] for r in got.values())
    assert got[1]["n"] > 50000 * 14


def test_builders_take_column_names(spark):
    """Q10: prompt / prediction / reference / def columns are parameters."""
    base = view(spark, SF_SMALL, "code_base")
    renamed = base.select(F.col("row_id").alias("id"), F.col("language"), F.col("prompt").alias("p"),
                          F.col("prediction").alias("out"), F.col("code_completion").alias("ref"),
                          F.col("function_def").alias("sig"))
    a = build_kto(base, 0.5, seed=2).select("row_id", "completion", "label")
    b = build_kto(renamed, 0.5, key="id", seed=2, prompt="p", prediction="out", reference="ref",
                  function_def="sig").select(F.col("id").alias("row_id"), "completion", "label")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bleu_forms_agree(spark):
    """In-row sentence BLEU equals BLEU from the long-form overlap table."""
    from codepref.operators.evaluate import bleu, ngram_overlap, sentence_bleu

    df = spark.createDataFrame([(1, "a b c d e", "a b c d f"), (2, "x", "y z"), (3, "a a a a", "a a b"),
                                (4, "", "q r")], "k long, c string, r string")
    long_form = sorted(map(tuple, bleu(ngram_overlap(df, ["k"], "c", "r"), ["k"]).collect()))
    in_row = sorted(map(tuple, sentence_bleu(df, ["k"], "c", "r").collect()))
    assert long_form == in_row and len(in_row) == 4
