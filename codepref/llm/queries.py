"""Registered queries of the operators, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepref.llm import (
    ann, decontam, htmltext, linedup, mixing, phrases, ppm, quality, quotes, sharding, simhash, spelling, warc)
from codepref.llm.common import crc_mod, materialize, scratch, table


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")), path)
    records = warc.read_records(spark, path)
    full, body = F.col("type") == "response", warc.http_payload(F.col("block"))
    # payloads are digested as they are read; only the short records keep their block
    short = materialize(records.withColumn("sha1", F.when(full, F.sha1(body))).withColumn("bytes", F.when(full, F.length(body)))
                        .withColumn("block", F.when(F.col("type").isin("request", "metadata"), F.col("block"))))
    told = F.regexp_extract(F.decode(F.col("metadata")[0]["block"], "UTF-8"), r"payloadBytes: (\d+)", 1).cast("bigint")
    return warc.assemble(short).select(
        F.col("headers")["x-page-id"].cast("bigint").alias("page_id"),
        F.coalesce(F.col("bytes").cast("bigint"), told).alias("payload_bytes"),
        F.coalesce("sha1", F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("headers")["x-refers-to-page-id"].cast("bigint").alias("refers_to"),
        "target_uri", F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"))


OP1_SQL = """
WITH p AS (SELECT page_id, replace(replace(coalesce(url, ''), chr(13), '%0A'), chr(10), '%0A') AS target_uri,
    CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top > page_id THEN top END AS refers_to, target_uri, 1 AS n_requests, 1 AS n_metadata FROM q
"""


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
                      "shard", "shard_depth", "shard_page", "oversize")


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':shard'), 1, 15))::BIGINT AS h FROM documents),
up AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS total
    FROM d, (SELECT unnest(range(61)) AS depth) GROUP BY ALL),
leaf AS (SELECT d.*, (SELECT min(depth) FROM up WHERE prefix = h >> (60 - depth) AND total <= {sharding.LIMIT}) AS leaf FROM d)
SELECT doc_id, bytes, 'b' || left(right(repeat('0', 60) || bin(h), 60), coalesce(leaf, 60)::INT) AS shard,
  coalesce(leaf, 60)::INT AS shard_depth, 0::BIGINT AS shard_page, leaf IS NULL AS oversize FROM leaf
"""


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.digest(found)


# DuckDB's \\s-free word classes are those of the contract; windows are joined on
# their text, so this is an independent exact form.
OP5_SQL = r"""
WITH lowered AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes WHERE len(w) >= n)),
hits AS (SELECT r, item_id, i, grams.n FROM grams JOIN wins ON grams.n = wins.n AND grams.s = wins.s),
per AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN per USING (r) LEFT JOIN ids USING (r)
"""


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail threads in which each turn quotes the two before."""
    out = quotes.link(quotes.quoting_thread(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", F.col("own_text").alias("text"), F.col("parent").alias("parent_turn"),
                      F.col("root").alias("root_turn"), "depth", "reply_order", "n_quoted", "n_linked")


def op8_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS idx FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((idx - 1) % 3 + 1)::INT] AS weight FROM s0),
s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size) OVER b, 0) * 3)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
    FROM s1 WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src AS (SELECT source, idx, source_size, greatest(0.0::DOUBLE, least(CAST(source_size * 3 AS DOUBLE), max(level) OVER () * weight)) AS target FROM s2),
q AS (SELECT doc_id, size, source_size, target, idx, h, sum(size) OVER (PARTITION BY idx ORDER BY h, doc_id) AS cum
    FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
turns AS (SELECT *, CASE WHEN target > 0 THEN CAST(pass * source_size + cum AS DOUBLE) / target ELSE 0.0 END AS finish
    FROM (SELECT *, unnest(range(CASE WHEN target > 0 THEN least(3, CAST(ceil(target / source_size) AS INT)) ELSE 1 END)) AS pass FROM q)),
merged AS (SELECT *, sum(size) OVER (ORDER BY finish, idx, pass, h, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM turns)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN total <= (SELECT sum(source_size) FROM src) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM merged GROUP BY doc_id, size, source_size, target
"""


def op6_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


# All pairs of distinct word sets of fitting lengths, compared word by word.
OP9_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
s AS (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^ 	-
]+'))) AS w FROM l),
c AS (SELECT w, len(w) AS n, min((doc_id, line_no)) AS spot FROM s WHERE len(w) > 0 GROUP BY w),
n AS (SELECT *, row_number() OVER (ORDER BY spot) AS sid FROM c),
p AS (SELECT a.sid AS a, b.sid AS b FROM n a JOIN n b ON b.n <= a.n AND b.n * 5 >= a.n * 4 AND a.sid <> b.sid AND (b.n < a.n OR a.sid < b.sid)
    AND 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
e AS (SELECT a AS sid, b AS other FROM p UNION ALL SELECT b, a FROM p),
per AS (SELECT sid, min(other) AS first, count(*) AS n_links FROM e GROUP BY sid),
hit AS (SELECT doc_id, line_no, coalesce(n_links, 0) AS n_links, coalesce(first < n.sid, false) OR n.spot < (doc_id, line_no) AS removed
    FROM s JOIN n ON s.w = n.w LEFT JOIN per USING (sid))
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
  coalesce(list(CAST(line_no AS INT) ORDER BY line_no) FILTER (WHERE removed), []) AS removed_lines,
  count(*) FILTER (WHERE removed) AS n_removed, CAST(coalesce(sum(n_links), 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id, d.text
"""


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ppm.score(docs, docs.where(~ppm.held_out()))
    return scored.select("doc_id", ppm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


# All phrases of up to five words are written out and counted.
OP11_SQL = r"""
WITH p AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, len, array_to_string(w[i:i + len - 1], ' ') AS phrase
    FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS len) WHERE len(w) >= len)),
f AS (SELECT lang, phrase, len, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, len, f AS a FROM f WHERE len > 1 AND f >= 100),
inner_ AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS above
    FROM (SELECT lang, w, a, m, unnest(range(1, len - m + 2)) AS s FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < len) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ i ON c.lang = i.lang AND c.phrase = i.phrase WHERE above IS NULL OR 100 * above < 100 * a),
cut AS (SELECT lang, phrase, w, a, len, unnest(range(1, len)) AS k FROM kept),
s AS (SELECT cut.lang, cut.phrase, k, a, x.f AS l, y.f AS r, n,
      CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ')
    JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:cut.len], ' ') JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.words(table(spark, sf_dir, "documents").select("doc_id", "text")))


# crc32 by its table (polynomial EDB88320); neighbours by their texts without one code point.
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
run AS (SELECT doc, run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) AS run
    FROM documents) GROUP BY ALL),
hexed AS (SELECT run, k, hex(encode(doc || ':' || run)) AS x FROM run),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda p: ('0x' || substr(x, p::INT, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 31 = 0
    THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING n >= 2),
less AS (SELECT word, n, p, left(word, p::INT) || substr(word, p::INT + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS p FROM vocab)),
pair AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
    UNION SELECT l.word, v.word FROM less l JOIN vocab v ON l.cut = v.word
    UNION SELECT v.word, l.word FROM less l JOIN vocab v ON l.cut = v.word),
best AS (SELECT p.word, count(*) AS n_near, arg_min(v.word, (-v.n, v.word)) AS top, max(v.n) AS m FROM pair p JOIN vocab v ON v.word = p.near GROUP BY p.word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN top END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
    FROM vocab v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, 0 AS steps FROM formed UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, u.root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(root, steps) AS root FROM up GROUP BY word) u USING (word)
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_transactions, op2_extendible_sharding, op3_compression_classifier, op4_simhash_multi_index,
                            op5_positional_index, op6_adaptive_scan, op7_quotation_linking, op8_fair_queueing, op9_line_dedup, op10_ppm_scoring,
                            op11_phrase_collocations, op12_spelling_variants, op13_main_text)}
ORACLES: dict[str, str] = {"op1_warc_transactions": OP1_SQL, "op2_extendible_sharding": OP2_SQL, "op5_positional_index": OP5_SQL,
                           "op8_fair_queueing": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_phrase_collocations": OP11_SQL,
                           "op12_spelling_variants": OP12_SQL}
