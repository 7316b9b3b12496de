"""Queries: model tokens of a public vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from codepref.operators import embed as em
from codepref.operators.profile import length_histogram
from codepref.operators.tokenize import read_vocabulary, token_ids, token_length
from codepref.plans.catalog import register
from codepref.sources.tables import read_table

#: The vocabulary of the queries.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# RE2 has no look-ahead: the white space before another character is marked first, and
# a marked blank belongs to what follows.
_WS = r"\t-\r \x{85}\p{Z}"
_PIECE = (rf"'s|'t|'re|'ve|'m|'ll|'d|(?:\x01 )?\p{{L}}+|(?:\x01 )?\p{{N}}+|(?:\x01 )?[^{_WS}\p{{L}}\p{{N}}\x01]+|\x01[{_WS}]|[{_WS}]+")
# Merges by rank, one pair of each distinct piece at a time; bytes as hex digits.
TOKENS_SQL = f"""
WITH RECURSIVE ranks AS (SELECT hex(from_base64(b)) AS h, r FROM read_csv('{VOCABULARY}', delim = ' ', header = false,
    columns = {{'b': 'VARCHAR', 'r': 'INT'}}, quote = '', escape = '', auto_detect = false)),
cut AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([{_WS}])([^{_WS}])', chr(1) || '\\1\\2', 'g'), '{_PIECE.replace("'", "''")}') AS p FROM documents),
pieces AS (SELECT doc_id, i, replace(p[i], chr(1), '') AS tok FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut)),
bpe AS (SELECT tok, list_transform(range(1, len(x), 2), lambda k: substr(x, k::INT, 2)) AS parts FROM (SELECT DISTINCT tok, hex(encode(tok)) AS x FROM pieces)
  UNION ALL
  SELECT tok, list_concat(parts[1:i - 1], [parts[i] || parts[i + 1]], parts[i + 2:]) AS parts
  FROM (SELECT tok, parts, arg_min(i, (r, i)) AS i FROM (SELECT tok, parts, unnest(range(1, len(parts))) AS i FROM bpe) p
        JOIN ranks ON h = parts[i] || parts[i + 1] GROUP BY tok, parts)),
merged AS (SELECT tok, arg_min(parts, len(parts)) AS parts FROM bpe GROUP BY tok),
coded AS (SELECT tok, list(r ORDER BY i) AS ids FROM (SELECT tok, parts[i] AS h, i FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM merged))
    JOIN ranks USING (h) GROUP BY tok),
doc AS (SELECT d.doc_id, coalesce(t, []) AS t FROM documents d LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY i)) AS t
    FROM pieces JOIN coded USING (tok) GROUP BY doc_id) USING (doc_id))"""


@register("a03_model_tokens", TOKENS_SQL + """,
b AS (SELECT CAST(floor(CASE WHEN len(t) > 2000 THEN 2000 ELSE len(t) END / 100) AS BIGINT) AS bucket, len(t) AS n FROM doc),
g AS (SELECT bucket, count(*) AS count, max(n) AS m FROM b GROUP BY bucket)
SELECT bucket, CAST(bucket * 100 AS VARCHAR) || '-' || CAST(CASE WHEN bucket = (SELECT max(bucket) FROM g)
       THEN (SELECT max(m) FROM g) ELSE (bucket + 1) * 100 - 1 END AS VARCHAR) AS label, count FROM g
""")
def a03_model_tokens(spark, sf_dir):
    """A3: histogram of the documents' lengths in a public vocabulary's tokens."""
    d = read_table(spark, sf_dir, "documents")
    n = token_length(F.col("text"), read_vocabulary(spark, VOCABULARY))
    return length_histogram(d.select(n.alias("n")), F.col("n"), 100, 2000)


@register("e01_model_chunks", TOKENS_SQL + """,
c AS (SELECT doc_id, t, unnest(range(0, (len(t) + 511) // 512)) AS chunk FROM doc)
SELECT doc_id, chunk, len(t[chunk * 512 + 1 : chunk * 512 + 512]) AS n_tok, md5(array_to_string(t[chunk * 512 + 1 : chunk * 512 + 512], ' ')) AS chunk_md5 FROM c
""")
def e01_model_chunks(spark, sf_dir):
    """Chunks of 512 tokens of a public vocabulary."""
    d = read_table(spark, sf_dir, "documents")
    c = em.chunk_tokens(d, "doc_id", token_ids(F.col("text"), read_vocabulary(spark, VOCABULARY)), 512)
    return c.select("doc_id", "chunk", F.size("tokens").cast("bigint").alias("n_tok"),
                    F.md5(F.array_join(F.col("tokens").cast("array<string>"), " ")).alias("chunk_md5"))
