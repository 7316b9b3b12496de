"""Queries: embedding pairs (E1-E6) and incremental labelling (ST1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codepref.functions.text import extract_completion, remove_markers, seeded_hash, sql_hash, tokens
from codepref.operators import embed as em
from codepref.plans.catalog import register
from codepref.plans.q_preference import LABELLED, _with
from codepref.sources.fixtures import oracle_ctes, view
from codepref.sources.tables import read_table

TOK = r"[\p{L}\p{N}_]+|\S"
WIDTH = 80


def _chunk_sql(n_chunks: str) -> str:
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{TOK}') AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(0, {n_chunks})) AS chunk FROM t)
SELECT doc_id, chunk, len(t[chunk * 512 + 1 : chunk * 512 + 512]) AS n_tok,
       md5(array_to_string(t[chunk * 512 + 1 : chunk * 512 + 512], ' ')) AS chunk_md5
FROM c
"""


def _chunks(spark, sf_dir, compat):
    d = read_table(spark, sf_dir, "documents")
    c = em.chunk_tokens(d, "doc_id", tokens(F.col("text")), 512, compat)
    return c.select("doc_id", "chunk", F.size("tokens").cast("bigint").alias("n_tok"),
                    F.md5(F.array_join("tokens", " ")).alias("chunk_md5"))


@register("e01_chunks", _chunk_sql("(len(t) + 511) // 512"))
def e01_chunks(spark, sf_dir):
    """512-token chunks of each document."""
    return _chunks(spark, sf_dir, False)


@register("e01_chunks_compat", _chunk_sql("len(t) // 512 + 1"))
def e01_chunks_compat(spark, sf_dir):
    """E1 literal: an exact multiple of 512 leaves an empty last chunk."""
    return _chunks(spark, sf_dir, True)


@register("e02_pad_mask", f"""
SELECT vec_id, list_concat(embedding, list_transform(range({WIDTH} - len(embedding)), lambda x: 0.0::FLOAT)) AS padded,
       list_transform(range(1, {WIDTH} + 1), lambda i: CASE WHEN i <= len(embedding) THEN 1 ELSE 0 END) AS mask
FROM embeddings
""")
def e02_pad_mask(spark, sf_dir):
    """Zero-padded vectors and masks."""
    e = read_table(spark, sf_dir, "embeddings")
    padded, mask = em.pad_with_mask(F.col("embedding"), WIDTH)
    return e.select("vec_id", padded.alias("padded"), mask.alias("mask"))


@register("e03_pair_texts", _with(LABELLED) + """
SELECT b.row_id, b.documentation || chr(10) || b.function_def || chr(10) || b.code_completion AS chosen_text,
       b.documentation || chr(10) || b.function_def || chr(10) || l.code AS rejected_text
FROM code_base b JOIN lab0 l USING (row_id)
""")
def e03_pair_texts(spark, sf_dir):
    """(doc + reference, doc + prediction) texts."""
    b = view(spark, sf_dir, "code_base")
    code = extract_completion(remove_markers(F.col("prediction")), F.col("prompt"))
    ref = F.concat(F.col("function_def"), F.lit("\n"), F.col("code_completion"))
    pred = F.concat(F.col("function_def"), F.lit("\n"), code)
    pos, neg = em.pair_texts(F.col("documentation"), ref, pred, sep="\n")
    return b.select("row_id", pos.alias("chosen_text"), neg.alias("rejected_text"))


@register("e03_pair_raw", oracle_ctes("code_base", "code_raw") + """
SELECT r.row_id, r.func_documentation_string || r.func_code_string AS chosen_text,
       r.func_documentation_string || b.prediction AS rejected_text
FROM code_raw r JOIN code_base b USING (row_id)
""")
def e03_pair_raw(spark, sf_dir):
    """E3 on the raw columns, nothing between documentation and code."""
    r = view(spark, sf_dir, "code_raw").select("row_id", "func_documentation_string", "func_code_string")
    both = r.join(view(spark, sf_dir, "code_base").select("row_id", "prediction"), "row_id")
    pos, neg = em.pair_texts(F.col("func_documentation_string"), F.col("func_code_string"), F.col("prediction"))
    return both.select("row_id", pos.alias("chosen_text"), neg.alias("rejected_text"))


MEAN_SQL = "list_reduce(embedding, lambda acc, x: acc + x::DOUBLE, 0.0::DOUBLE) / len(embedding)"


@register("e04_pair_score", f"""
SELECT a.vec_id // 2 AS pair_id, round(tanh(a.s - b.s), 9) AS score
FROM (SELECT vec_id, {MEAN_SQL} AS s FROM embeddings WHERE vec_id % 2 = 0) a
JOIN (SELECT vec_id, {MEAN_SQL} AS s FROM embeddings WHERE vec_id % 2 = 1) b ON b.vec_id = a.vec_id + 1
""")
def e04_pair_score(spark, sf_dir):
    """tanh(s(a) - s(b)) over consecutive embedding pairs."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", em.mean_score(F.col("embedding")).alias("s"))
    a = e.where(F.col("vec_id") % 2 == 0).select((F.col("vec_id") / 2).cast("bigint").alias("pair_id"),
                                                 F.col("s").alias("sa"))
    b = e.where(F.col("vec_id") % 2 == 1).select(((F.col("vec_id") - 1) / 2).cast("bigint").alias("pair_id"),
                                                 F.col("s").alias("sb"))
    return a.join(b, "pair_id").select("pair_id", F.round(em.pair_score(F.col("sa"), F.col("sb")), 9).alias("score"))


E5_STEPS = 3
E5_SQL = """
WITH pairs AS (SELECT a.vec_id // 2 AS p, a.embedding AS a, b.embedding AS b, CASE WHEN a.label > b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0 WHERE a.label <> b.label),
parts AS (SELECT p, y, i - 1 AS idx, a[i]::DOUBLE - b[i]::DOUBLE AS d FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM pairs)),
w0 AS (SELECT DISTINCT idx, 0.0::DOUBLE AS weight FROM parts)""" + "".join(f""",
m{s} AS (SELECT p, sum(weight * d) AS m FROM parts JOIN w{s} USING (idx) GROUP BY p),
w{s + 1} AS (SELECT w.idx, w.weight + g.g / (SELECT count(*) FROM pairs) AS weight FROM w{s} w JOIN (
    SELECT idx, sum((y - 1.0 / (1.0 + exp(-m))) * d) AS g FROM parts JOIN m{s} USING (p) GROUP BY idx) g USING (idx))"""
    for s in range(E5_STEPS)) + f"""
SELECT CAST(idx AS INT) AS idx, round(weight, 9) AS weight FROM w{E5_STEPS}
"""


@register("e05_pair_fit", E5_SQL)
def e05_pair_fit(spark, sf_dir):
    """E5: Bradley-Terry pair scorer on embedding pairs with different labels, by
    three full-batch gradient steps from zero; one row per component."""
    e = read_table(spark, sf_dir, "embeddings")
    a = e.where(F.col("vec_id") % 2 == 0).select((F.col("vec_id") / 2).cast("bigint").alias("p"),
                                                 F.col("embedding").alias("a"), F.col("label").alias("la"))
    b = e.where(F.col("vec_id") % 2 == 1).select(((F.col("vec_id") - 1) / 2).cast("bigint").alias("p"),
                                                 F.col("embedding").alias("b"), F.col("label").alias("lb"))
    pairs = a.join(b, "p").where(F.col("la") != F.col("lb")).withColumn("y", (F.col("la") > F.col("lb")).cast("int"))
    fitted = em.descend_pair_scorer(pairs, steps=E5_STEPS)
    return fitted.select("idx", F.round("weight", 9).alias("weight"))


@register("e06_equal", """
SELECT a.vec_id, a.embedding = b.embedding AS equal FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 3
""")
def e06_equal(spark, sf_dir):
    """E1 reassembly + E6: cut vectors into 16-wide chunks, reassemble by key and
    compare every vector with one of its neighbourhood (itself for each third)."""
    e = read_table(spark, sf_dir, "embeddings")
    ch = em.chunk_tokens(e, "vec_id", F.col("embedding"), 16).withColumnRenamed("tokens", "vec")
    back = em.reassemble(ch, "vec_id", "chunk", "vec").withColumnRenamed("vec", "back")
    back = back.withColumnRenamed("vec_id", "other")
    return e.join(back, F.col("other") == F.col("vec_id") - F.col("vec_id") % 3).select(
        "vec_id", em.vectors_equal(F.col("embedding"), F.col("back")).alias("equal"))


ST1_BATCHES = 4


@register("st1_incremental", _with(LABELLED) + "SELECT row_id, language, code, valid FROM lab")
def st1_incremental(spark, sf_dir):
    """ST1: base rows arrive as files; Structured Streaming labels them
    micro-batch by micro-batch into an idempotent sink."""
    from codepref.session import checkpoint_dir
    from codepref.streaming.incremental import label_stream

    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    base = view(spark, sf_dir, "code_base")
    base.write.option("compression", "zstd").parquet(f"{root}/in")  # a file of each task: no file or task grows with the table
    per_batch = -(-len(spark.read.parquet(f"{root}/in").inputFiles()) // ST1_BATCHES)
    out = label_stream(spark, f"{root}/in", base.schema, f"{root}/out", f"{root}/ckpt", max_files_per_trigger=max(1, per_batch))
    return out.select("row_id", "language", "code", "valid")


ST2_ROWS, ST2_PARTS = 70, 3


@register("st2_take_skip", oracle_ctes("code_base") + f"""
SELECT row_id, row_number() OVER (ORDER BY {sql_hash('row_id', 'feed')} % {ST2_PARTS}, {sql_hash('row_id', 0)}, row_id) <= {ST2_ROWS} AS taken
FROM code_base
""")
def st2_take_skip(spark, sf_dir):
    """ST2: the first rows of a stream, and all but the first. Files arrive in three
    steps; after each the query restarts from its checkpoint."""
    from codepref.session import checkpoint_dir
    from codepref.streaming.limits import skipped, split_stream, taken

    root = f"{checkpoint_dir(spark).rstrip('/')}/limits-{uuid.uuid4().hex}"
    base = view(spark, sf_dir, "code_base").select("row_id", "language", "prediction")
    for part in range(ST2_PARTS):
        base.where(seeded_hash("row_id", "feed") % ST2_PARTS == part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(base.schema).parquet(f"{root}/in")
        split_stream(stream, ST2_ROWS, f"{root}/out", f"{root}/checkpoint")
    first = taken(spark, f"{root}/out").select("row_id", F.lit(True).alias("taken"))
    return first.unionByName(skipped(spark, f"{root}/out").select("row_id", F.lit(False).alias("taken")))
