"""Queries: evaluation side."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codepref.functions.text import extract_completion, remove_markers
from codepref.operators import evaluate as ev
from codepref.operators.sampling import materialize, take_first
from codepref.operators.sanitize import assemble_prompts, predict, replicate, sanitize, stub_predictor
from codepref.plans.catalog import register
from codepref.plans.q_preference import LABELLED, _with
from codepref.plans.sql_parts import q, sql_balanced, sql_extract, sql_hash
from codepref.sources.fixtures import BROKEN_SQL, oracle_ctes, view
from codepref.session import checkpoint_dir
from codepref.sources.commits import CommitLog, predict_resumably
from codepref.sources.tables import read_run_grid, read_table

# The prompt templates of the evaluation runs (a tiny dimension).
TEMPLATES = (("plain", ""), ("task", "Complete the following function.\n"))
# The run grid (model x prompt) that sample ids are assigned to.
RUNS = (("r0", "base-1b", "plain"), ("r1", "base-1b", "oneshot"), ("r2", "kto-1b", "plain"))
SEED = 13


def _templates(spark):
    return list(TEMPLATES)


def _runs(spark):
    """The run grid as IO9 reads it: one JSON object per run."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    spark.createDataFrame(list(RUNS), "run_id string, model string, prompt string").coalesce(1).write.json(path)
    return read_run_grid(spark, path).select("run_id", "model", F.col("prompt").alias("prompt_name"))


def _problems(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("task_id"), F.lit("python").alias("language"),
                    F.col("text").alias("prompt"))


TEMPLATES_SQL = "(VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in TEMPLATES) + ") AS t(name, template)"
RUNS_SQL = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in RUNS) + ") AS g(run_id, model, prompt_name)"
STUB_SQL = "full_prompt || chr(10) || '    return ' || CAST(length(full_prompt) AS VARCHAR) || chr(10) || 'print()'"


@register("n14_prompts", f"""
SELECT b.item_id AS task_id, t.name, t.template || b.text AS full_prompt
FROM benchmark b CROSS JOIN {TEMPLATES_SQL}
""")
def n14_prompts(spark, sf_dir):
    """Templates x problems (broadcast templates)."""
    return assemble_prompts(_problems(spark, sf_dir), _templates(spark)).select("task_id", "name", "full_prompt")


@register("n15_replicate", """
SELECT item_id AS task_id, s.sample_id FROM benchmark CROSS JOIN generate_series(1, 3) AS s(sample_id)
""")
def n15_replicate(spark, sf_dir):
    """k = 3 samples per problem."""
    return replicate(_problems(spark, sf_dir), 3).select("task_id", "sample_id")


@register("n16_predict_stub", f"""
SELECT task_id, name, {STUB_SQL} AS prediction FROM (
  SELECT b.item_id AS task_id, t.name, t.template || b.text AS full_prompt
  FROM benchmark b CROSS JOIN {TEMPLATES_SQL})
""")
def n16_predict_stub(spark, sf_dir):
    """Batch predictions by a pluggable predictor (stub model),
    Arrow batches of 8 prompts, model built once per task."""
    p = assemble_prompts(_problems(spark, sf_dir), _templates(spark)).select("task_id", "name", "full_prompt")
    return predict(p, stub_predictor, "full_prompt", "prediction", batch_size=8).select(
        "task_id", "name", "prediction")


@register("n17_sanitise_predictions", f"""
SELECT task_id, name, {sql_extract(STUB_SQL, 'full_prompt')} AS completion FROM (
  SELECT b.item_id AS task_id, t.name, t.template || b.text AS full_prompt
  FROM benchmark b CROSS JOIN {TEMPLATES_SQL})
""")
def n17_sanitise_predictions(spark, sf_dir):
    """N17 + N13 on predictor output stored as one-element lists."""
    p = assemble_prompts(_problems(spark, sf_dir), _templates(spark)).select(
        "task_id", "name", "language", "full_prompt")
    pr = predict(p, stub_predictor, "full_prompt", "prediction", batch_size=8)
    pr = pr.withColumn("completion", F.array(F.col("prediction"))).drop("prediction")
    return sanitize(pr, prediction="completion", prompt="full_prompt").select("task_id", "name", "completion")


A1_SQL = f"""
a1 AS (SELECT b.row_id, b.language, b.prompt,
         CASE WHEN b.language = 'java' THEN l.code || chr(10) || '}}' ELSE l.code END AS completion
       FROM code_base b JOIN lab0 l USING (row_id)),
a1v AS (SELECT *, CASE WHEN language = 'python' THEN NOT {BROKEN_SQL.format('completion')} AND completion <> ''
                      ELSE {sql_balanced("prompt || chr(10) || completion", 'language')} END
                 AND length(completion) > 0 AS ok FROM a1)
"""


@register("a01_valid_rate", _with(LABELLED, A1_SQL) + """
SELECT language, count(*) FILTER (WHERE ok) AS n_valid, count(*) AS n_rows FROM a1v GROUP BY language
""")
def a01_valid_rate(spark, sf_dir):
    """A1: sanitised completions that are valid with their prompt, per language."""
    s = sanitize(view(spark, sf_dir, "code_base"), prediction="prediction", prompt="prompt")
    return ev.valid_rate(s, "prompt", "completion", "language", ["language"])


@register("a02_sample_rate", _with(LABELLED, A1_SQL) + f"""
SELECT count(*) FILTER (WHERE ok) AS n_valid, count(*) AS n_rows,
       (SELECT count(*) FROM code_base) AS n_total
FROM (SELECT *, row_number() OVER (ORDER BY {sql_hash('row_id', SEED)}, row_id) AS rn FROM a1v) WHERE rn <= 101
""")
def a02_sample_rate(spark, sf_dir):
    """A2: A1 on the first 101 rows, beside the full row count."""
    base = view(spark, sf_dir, "code_base")
    sample = materialize(take_first(base, 101, key="row_id", seed=SEED))  # extraction and checks see these only
    rate = ev.valid_rate(sanitize(sample, prediction="prediction", prompt="prompt"), by=[])
    none = F.lit(0).cast("bigint")
    total = base.agg(none.alias("n_valid"), none.alias("n_rows"), F.count(F.lit(1)).alias("n_total"))
    both = rate.select("n_valid", "n_rows", none.alias("n_total")).unionByName(total)
    return both.agg(*[F.sum(c).alias(c) for c in ("n_valid", "n_rows", "n_total")])


PASS_SQL = """
per_task AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM results GROUP BY task_id),
pk AS (SELECT task_id, n, c, {cols} FROM per_task)
"""


def _pk(k: int) -> str:
    prod = "1.0::DOUBLE"
    for j in range(k):
        prod = f"({prod} * ((n - c - {j}) / (n - {j})))"
    return f"CASE WHEN c = 0 THEN 0.0 WHEN n - c < {k} THEN 1.0 ELSE 1 - {prod} END AS pass_at_{k}"


PK_CTE = PASS_SQL.format(cols=", ".join(_pk(k) for k in (1, 5, 10)))


@register("a05_pass_at_k", oracle_ctes("results").rstrip() + ",\n" + PK_CTE + "SELECT * FROM pk")
def a05_pass_at_k(spark, sf_dir):
    """A5: unbiased pass@k per task (k = 1, 5, 10)."""
    return ev.pass_at_k(view(spark, sf_dir, "results"), (1, 5, 10))


@register("a05_pass_at_k_mean", oracle_ctes("results").rstrip() + ",\n" + PK_CTE + """
SELECT count(*) AS n_tasks, round(avg(pass_at_1), 9) AS pass_at_1, round(avg(pass_at_5), 9) AS pass_at_5,
       round(avg(pass_at_10), 9) AS pass_at_10 FROM pk
""")
def a05_pass_at_k_mean(spark, sf_dir):
    """A5: mean pass@k over tasks."""
    return ev.pass_at_k_mean(ev.pass_at_k(view(spark, sf_dir, "results"), (1, 5, 10)), (1, 5, 10))


RUN_SCORES = f"""
scored AS (SELECT g.model, g.prompt_name, b.language, r.passed
           FROM results r JOIN code_base b ON b.row_id = r.sample_id
           JOIN {RUNS_SQL} ON g.run_id = 'r' || CAST(r.sample_id % 3 AS VARCHAR))
"""


def _scored(spark, sf_dir):
    r = view(spark, sf_dir, "results")
    b = view(spark, sf_dir, "code_base").select(F.col("row_id").alias("sample_id"), "language")
    r = r.join(b, "sample_id").withColumn("run_id", F.concat(F.lit("r"), (F.col("sample_id") % 3).cast("string")))
    return r.join(F.broadcast(_runs(spark)), "run_id")


@register("a06_leaderboard", oracle_ctes("results", "code_base").rstrip() + ",\n" + RUN_SCORES + """
SELECT model, prompt_name, language, n, n_passed, pass_rate,
       rank() OVER (PARTITION BY language ORDER BY pass_rate DESC, model, prompt_name) AS rank
FROM (SELECT model, prompt_name, language, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed,
             round(count(*) FILTER (WHERE passed) / count(*), 9) AS pass_rate
      FROM scored GROUP BY model, prompt_name, language)
""")
def a06_leaderboard(spark, sf_dir):
    """A6 + J4: run grid x results, pass rate per (model, prompt, language), ranked."""
    s = _scored(spark, sf_dir).groupBy("model", "prompt_name", "language").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))
    s = s.withColumn("pass_rate", F.round(F.col("n_passed") / F.col("n"), 9))
    return ev.leaderboard(s, "pass_rate")


@register("a06_rollup", oracle_ctes("results", "code_base").rstrip() + ",\n" + RUN_SCORES + """
SELECT language, model, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed
FROM scored GROUP BY ROLLUP (language, model)
""")
def a06_rollup(spark, sf_dir):
    """A6 totals: rollup over (language, model)."""
    return _scored(spark, sf_dir).rollup("language", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))


TOK = r"[\p{L}\p{N}_]+|\S"
OVERLAP_SQL = """
pairs AS (SELECT {keys}, regexp_extract_all({cand}, '{tok}') AS tc, regexp_extract_all({ref}, '{tok}') AS tr FROM {src}),
grams AS (
  SELECT {keys}, n, array_to_string(tc[i:i + n - 1], ' ') AS g, 1 AS side
  FROM pairs CROSS JOIN range(1, {max_n} + 1) AS rn(n), LATERAL (SELECT unnest(range(1, len(tc) - n + 2)) AS i)
  UNION ALL
  SELECT {keys}, n, array_to_string(tr[i:i + n - 1], ' ') AS g, 0 AS side
  FROM pairs CROSS JOIN range(1, {max_n} + 1) AS rn(n), LATERAL (SELECT unnest(range(1, len(tr) - n + 2)) AS i)),
per_gram AS (SELECT {keys}, n, g, count(*) FILTER (WHERE side = 1) AS c, count(*) FILTER (WHERE side = 0) AS r
             FROM grams GROUP BY {keys}, n, g),
overlap AS (SELECT {keys}, CAST(n AS BIGINT) AS n, CAST(sum(least(c, r)) AS BIGINT) AS matches,
            CAST(sum(c) AS BIGINT) AS cand_total, CAST(sum(r) AS BIGINT) AS ref_total
            FROM per_gram GROUP BY {keys}, n)
"""


def _overlap_sql(keys: str, cand: str, ref: str, src: str, max_n: int) -> str:
    return OVERLAP_SQL.format(keys=keys, cand=cand, ref=ref, src=src, max_n=max_n, tok=TOK)


@register("a07_bleu_counts", _with(LABELLED, _overlap_sql("row_id", "code", "reference", "lab0", 4)) + """
SELECT row_id, n, matches, cand_total, ref_total FROM overlap
""")
def a07_bleu_counts(spark, sf_dir):
    """Clipped n-gram matches (n = 1..4) of predicted vs reference bodies."""
    b = view(spark, sf_dir, "code_base")
    d = b.select("row_id", extract_completion(remove_markers(F.col("prediction")), F.col("prompt")).alias("code"),
                 F.col("code_completion").alias("reference"))
    return ev.ngram_overlap(d, ["row_id"], "code", "reference", 4)


@register("a07_bleu", _with(LABELLED, _overlap_sql("row_id", "code", "reference", "lab0", 4)) + """
SELECT row_id, round(CASE WHEN least(coalesce(p1, 0), coalesce(p2, 0), coalesce(p3, 0), coalesce(p4, 0)) = 0
                          OR c_len = 0 THEN 0.0
  ELSE (CASE WHEN c_len > r_len THEN 1.0 ELSE exp(1 - r_len / c_len) END)
       * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END, 9) AS bleu
FROM (SELECT row_id, max(CASE WHEN n = 1 AND cand_total > 0 THEN matches / cand_total END) AS p1,
        max(CASE WHEN n = 2 AND cand_total > 0 THEN matches / cand_total END) AS p2,
        max(CASE WHEN n = 3 AND cand_total > 0 THEN matches / cand_total END) AS p3,
        max(CASE WHEN n = 4 AND cand_total > 0 THEN matches / cand_total END) AS p4,
        max(CASE WHEN n = 1 THEN cand_total END) AS c_len, max(CASE WHEN n = 1 THEN ref_total END) AS r_len
      FROM overlap GROUP BY row_id)
""")
def a07_bleu(spark, sf_dir):
    """Sentence BLEU of predicted vs reference bodies (in-row)."""
    b = view(spark, sf_dir, "code_base")
    d = b.select("row_id", extract_completion(remove_markers(F.col("prediction")), F.col("prompt")).alias("code"),
                 F.col("code_completion").alias("reference"))
    return ev.sentence_bleu(d, ["row_id"], "code", "reference", 4)


@register("a07_rouge_n", oracle_ctes("conv_pairs").rstrip() + ",\n"
          + _overlap_sql("conv_id, turn", "completion", "prompt", "conv_pairs", 2).strip() + """
SELECT conv_id, turn, round(CASE WHEN ref_total > 0 THEN matches / ref_total ELSE 0.0 END, 9) AS recall,
  round(CASE WHEN cand_total > 0 THEN matches / cand_total ELSE 0.0 END, 9) AS precision,
  round(CASE WHEN matches > 0 THEN 2 * (matches / ref_total) * (matches / cand_total)
        / ((matches / ref_total) + (matches / cand_total)) ELSE 0.0 END, 9) AS f1
FROM overlap WHERE n = 2
""")
def a07_rouge_n(spark, sf_dir):
    """ROUGE-2 of answers against their prompts (conversation turns)."""
    p = view(spark, sf_dir, "conv_pairs")
    return ev.rouge_n(ev.ngram_overlap(p, ["conv_id", "turn"], "completion", "prompt", 2), ["conv_id", "turn"], 2)


@register("a07_corpus_bleu", _with(LABELLED, _overlap_sql("language, row_id", "code", "reference", "lab0", 4)) + """
SELECT language, m.cand_tokens, m.ref_tokens, round(CASE WHEN least(p1, p2, p3, p4) = 0 THEN 0.0
  ELSE (CASE WHEN cand_tokens > ref_tokens THEN 1.0 ELSE exp(1 - ref_tokens / cand_tokens) END)
       * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END, 9) AS bleu
FROM (SELECT language, CAST(sum(cand_total) FILTER (WHERE n = 1) AS BIGINT) AS cand_tokens, CAST(sum(ref_total) FILTER (WHERE n = 1) AS BIGINT) AS ref_tokens,
        sum(matches) FILTER (WHERE n = 1) / sum(cand_total) FILTER (WHERE n = 1) AS p1, sum(matches) FILTER (WHERE n = 2) / sum(cand_total) FILTER (WHERE n = 2) AS p2,
        sum(matches) FILTER (WHERE n = 3) / sum(cand_total) FILTER (WHERE n = 3) AS p3, sum(matches) FILTER (WHERE n = 4) / sum(cand_total) FILTER (WHERE n = 4) AS p4
      FROM overlap GROUP BY language) m
""")
def a07_corpus_bleu(spark, sf_dir):
    """BLEU of all predicted against all reference bodies of a language."""
    b = view(spark, sf_dir, "code_base")
    d = b.select("language", "row_id", extract_completion(remove_markers(F.col("prediction")), F.col("prompt")).alias("code"),
                 F.col("code_completion").alias("reference"))
    return ev.corpus_bleu(ev.ngram_overlap(d, ["language", "row_id"], "code", "reference", 4), ["language"])


@register("a07_rouge_l")
def a07_rouge_l(spark, sf_dir):
    """ROUGE-L of answers against their prompts (conversation turns); no SQL form,
    held against the quadratic table under pytest."""
    p = view(spark, sf_dir, "conv_pairs")
    return ev.rouge_l(p, ["conv_id", "turn"], "completion", "prompt")


@register("a08_fingerprint", """
SELECT doc_id, md5('{"doc_id": ' || CAST(doc_id AS VARCHAR) || ', "lang": "' || lang || '", "n_chars": '
       || CAST(n_chars AS VARCHAR) || ', "source": "' || source || '"}') AS fingerprint
FROM documents
""")
def a08_fingerprint(spark, sf_dir):
    """md5 of the key-sorted JSON of each record."""
    d = read_table(spark, sf_dir, "documents")
    fp = ev.fingerprint({"doc_id": d["doc_id"].cast("string"), "lang": ev.json_string(d["lang"]),
                         "n_chars": d["n_chars"].cast("string"), "source": ev.json_string(d["source"])})
    return d.select("doc_id", fp.alias("fingerprint"))


@register("a08_nested", """
SELECT vec_id, md5('{"label": ' || CAST(label AS VARCHAR) || ', "vector": {"head": [' || array_to_string(list_transform(embedding[1:3],
         lambda x: CAST(x::DOUBLE AS VARCHAR)), ', ') || '], "odd": ' || CASE WHEN vec_id % 2 = 1 THEN 'true' ELSE 'false' END
       || ', "sizes": {"big": ' || CASE WHEN vec_id % 3 = 0 THEN 'null' ELSE CAST(vec_id AS VARCHAR) END || ', "n": ' || CAST(len(embedding) AS VARCHAR) || '}}}') AS fingerprint
FROM embeddings
""")
def a08_nested(spark, sf_dir):
    """md5 of the key-sorted JSON of nested records (struct, map, array, double, null)."""
    e = read_table(spark, sf_dir, "embeddings")
    sizes = F.create_map(F.lit("n"), F.size("embedding").cast("bigint"), F.lit("big"), F.when(F.col("vec_id") % 3 != 0, F.col("vec_id")))
    vector = F.struct(sizes.alias("sizes"), (F.col("vec_id") % 2 == 1).alias("odd"), F.slice("embedding", 1, 3).cast("array<double>").alias("head"))
    rows = e.select("vec_id", vector.alias("vector"), "label")
    return rows.select("vec_id", ev.fingerprint_rows(rows, "vector", "label").alias("fingerprint"))


IO7_PARTS = 4


@register("io07_resume", oracle_ctes("code_base") + f"""
SELECT row_id, 1 + {sql_hash('row_id', 'batch')} % {IO7_PARTS} AS revision,
       prompt || chr(10) || '    return ' || CAST(length(prompt) AS VARCHAR) || chr(10) || 'print()' AS prediction
FROM code_base
""")
def io07_resume(spark, sf_dir):
    """IO7: predictions saved part by part as revisions, by a run that ends after two
    parts and a second one that predicts the rest."""
    rows = view(spark, sf_dir, "code_base").select("row_id", "prompt")
    log = CommitLog(spark, f"{checkpoint_dir(spark).rstrip('/')}/commits-{uuid.uuid4().hex}")
    for at_most in (2, None):
        predict_resumably(rows, stub_predictor, log, "row_id", "prompt", batches=IO7_PARTS, at_most=at_most)
    return log.read().select("row_id", "revision", "prediction")


@register("j02_score_join", f"""
SELECT p.task_id, p.sample_id, length(b.text) AS prompt_len,
       b.text || chr(10) || '    return ' || CAST(length(b.text) AS VARCHAR) || chr(10) || 'print()' AS prediction
FROM (SELECT item_id AS task_id, s.sample_id FROM benchmark CROSS JOIN generate_series(1, 2) AS s(sample_id)) p
JOIN benchmark b ON b.item_id = p.task_id
""")
def j02_score_join(spark, sf_dir):
    """Sampled predictions joined back to their problems by task id."""
    probs = _problems(spark, sf_dir)
    preds = predict(replicate(probs, 2).withColumnRenamed("prompt", "full_prompt"), stub_predictor,
                    "full_prompt", "prediction").select("task_id", "sample_id", "prediction")
    return ev.score_join(preds, probs.select("task_id", F.length("prompt").cast("bigint").alias("prompt_len"))).select(
        "task_id", "sample_id", "prompt_len", "prediction")
