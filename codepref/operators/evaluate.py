"""Evaluation (A1, A2, A5-A8, J2, J4): valid-code rates, pass@k, n-gram
similarity, leaderboards and run fingerprints.

All aggregates are plain ``groupBy`` with map-side partial aggregation, so a
hot key (one benchmark or language holding a third of the rows) is combined
per task before the shuffle; windows only run over aggregated rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepref.functions.text import tokens
from codepref.operators.validity import valid_code


def valid_rate(df: DataFrame, prompt: str = "prompt", completion: str = "completion",
               language: str = "language", by=("language",)) -> DataFrame:
    """A1: completions that are valid after ``prompt + "\\n" + completion`` and
    not empty, per group, next to the row count."""
    ok = valid_code(F.concat(F.col(prompt), F.lit("\n"), F.col(completion)), F.col(language)) \
        & (F.length(F.col(completion)) > 0)
    return (df.withColumn("_ok", ok).groupBy(*by)
            .agg(F.count_if("_ok").alias("n_valid"), F.count(F.lit(1)).alias("n_rows")))


def pass_at_k_expr(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k, 1 - C(n - c, k) / C(n, k), as k factors:
    1 - prod_{j<k} (n - c - j) / (n - j); 0 when c = 0, 1 when n - c < k."""
    prod = F.lit(1.0)
    for j in range(k):
        prod = prod * F.try_divide(n - c - j, n - j)
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - prod)


def pass_at_k(results: DataFrame, ks=(1, 5, 10), task: str = "task_id", passed: str = "passed",
              by=()) -> DataFrame:
    """A5 per task: n samples, c passed, pass@k for each k."""
    g = results.groupBy(*by, task).agg(F.count(F.lit(1)).alias("n"),
                                       F.count_if(F.col(passed)).alias("c"))
    for k in ks:
        g = g.withColumn(f"pass_at_{k}", pass_at_k_expr(F.col("n"), F.col("c"), k))
    return g


def pass_at_k_mean(per_task: DataFrame, ks=None, by=(), digits: int = 9) -> DataFrame:
    """A5: mean over tasks (rounded: summation order differs between engines);
    ``ks`` defaults to every ``pass_at_<k>`` column present."""
    if ks is None:
        ks = [int(c.rsplit("_", 1)[1]) for c in per_task.columns if c.startswith("pass_at_")]
    return per_task.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        *[F.round(F.avg(f"pass_at_{k}"), digits).alias(f"pass_at_{k}") for k in ks])


_OVERLAP = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "matches", "cand_total", "ref_total")]))
_SEP = "\x01"


_TOKENS = pa.list_(pa.string())


def _or_zero(numbers: pa.Array) -> np.ndarray:
    return np.nan_to_num(numbers.to_numpy(zero_copy_only=False)).astype(np.int64)


def _token_lists(texts: pa.Array) -> pa.Array:
    """The tokens of joined texts (null and empty: none)."""
    lists = pc.split_pattern(texts, _SEP)
    sizes = _sizes(lists)
    empty = (_or_zero(pc.binary_length(texts)) == 0) & (sizes == 1)
    keep = np.ones(sizes.sum(), bool)  # an empty text was split into one empty token
    keep[(sizes.cumsum() - sizes)[empty]] = False
    offsets = np.concatenate([[0], np.where(empty, 0, sizes).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), lists.flatten().filter(pa.array(keep)))


def _sizes(lists: pa.Array) -> np.ndarray:
    return _or_zero(pc.list_value_length(lists))


def _numbered(values: pa.Array | np.ndarray) -> tuple[np.ndarray, int]:
    """Each value's number among the distinct ones, and how many those are."""
    found = (pa.array(values) if isinstance(values, np.ndarray) else values).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def _overlaps_of(cand: pa.Array | list[list[str]], ref: pa.Array | list[list[str]], max_n: int) -> np.ndarray:
    """(rows, max_n): clipped matches of n = 1..max_n of each row's two token lists,
    counted for the whole batch at once: a gram is numbered with its row and counted per
    side, and the smaller counts are added up per row. A longer gram can only match where
    its first n - 1 tokens do; the others are dropped."""
    lists = [x if isinstance(x, pa.Array) else pa.array(x, _TOKENS) for x in (cand, ref)]
    flat, sizes = [x.flatten() for x in lists], [_sizes(x) for x in lists]
    n_rows, n_cand = len(cand), len(flat[0])
    out = np.zeros((n_rows, max_n), np.int64)
    code, width = _numbered(pa.concat_arrays(flat))
    row = np.concatenate([np.repeat(np.arange(n_rows), s) for s in sizes])
    end = np.concatenate([np.repeat(np.cumsum(s), s) + before for s, before in zip(sizes, (0, n_cand))])
    at = np.arange(len(code))  # where the grams end, of those that are left
    key = row * max(1, width) + code
    for n in range(max_n):
        gram, wide = _numbered(key)
        first = at < n_cand
        both = np.minimum(np.bincount(gram[first], minlength=wide), np.bincount(gram[~first], minlength=wide))
        of = np.zeros(wide, np.int64)
        of[gram] = row[at]
        out[:, n] = np.bincount(of, both, n_rows) if wide else 0
        on = (both[gram] > 0) & (at + 1 < end[at]) if wide else np.zeros(0, bool)
        at, gram = at[on] + 1, gram[on]
        key = gram * max(1, width) + code[at]
    return out


def _slices(*sides: pa.Array, size: int = 1_000_000) -> Iterator[slice]:
    """Slices of a batch that hold about ``size`` bytes, or one row."""
    lengths = sum(_or_zero(pc.binary_length(side)) for side in sides)
    group = lengths.cumsum() // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _overlap_column(candidate: Column, reference: Column, max_n: int) -> Column:
    """Per row, the overlaps of both token lists. Tokens are cut in the JVM and
    cross to Python as one joined string per side (one Arrow batch at a time, which
    stays in Arrow's arrays); both sides of a pair are in the same row, so nothing is
    shuffled."""
    @F.arrow_udf(_OVERLAP)
    def overlaps(cand: pa.Array, ref: pa.Array) -> pa.Array:
        n_rows = len(cand)
        matches, totals = np.zeros((n_rows, max_n), np.int64), np.zeros((2, n_rows, max_n), np.int64)
        for part in _slices(cand, ref):
            sides = [_token_lists(side[part]) for side in (cand, ref)]
            matches[part] = _overlaps_of(*sides, max_n)
            for total, side in zip(totals, sides):
                total[part] = np.maximum(_sizes(side)[:, None] - np.arange(max_n), 0)
        columns = [np.tile(np.arange(1, max_n + 1), n_rows), matches.ravel(), *(t.ravel() for t in totals)]
        items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.name for f in _OVERLAP.elementType])
        return pa.ListArray.from_arrays(np.arange(n_rows + 1, dtype=np.int32) * max_n, items)

    # nondeterministic on purpose: a filter on what it found would else count once more below
    return overlaps.asNondeterministic()(F.array_join(tokens(candidate), _SEP), F.array_join(tokens(reference), _SEP))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence. A row of the table is one whole
    number whose zero bits mark where the length grows (Crochemore et al., 2001), so two
    texts of n tokens take n steps on n bits."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def _subsequences(cand: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(c.split(_SEP) if c else [], r.split(_SEP) if r else []) for c, r in zip(cand, ref)], dtype="int64")


def rouge_l(df: DataFrame, keys, candidate: str, reference: str, digits: int = 9) -> DataFrame:
    """Per row the longest common subsequence of both token lists, and ROUGE-L
    recall, precision and F1 from it (0 where a side has no tokens; null texts are empty)."""
    keys = list(keys)
    sides = {c: F.coalesce(tokens(F.col(t)), F.array().cast("array<string>")) for c, t in (("c", candidate), ("r", reference))}
    d = df.select(*keys, *[F.array_join(v, _SEP).alias(f"_{c}") for c, v in sides.items()],
                  *[F.size(v).cast("bigint").alias(f"_n{c}") for c, v in sides.items()])
    d = d.withColumn("lcs", _subsequences("_c", "_r"))
    rec, prec = (F.when(F.col(n) > 0, F.col("lcs") / F.col(n)).otherwise(0.0) for n in ("_nr", "_nc"))
    f1 = F.when(F.col("lcs") > 0, 2 * rec * prec / (rec + prec)).otherwise(0.0)
    return d.select(*keys, "lcs", F.round(rec, digits).alias("recall"), F.round(prec, digits).alias("precision"),
                    F.round(f1, digits).alias("f1"))


def ngram_overlap(df: DataFrame, keys, candidate: str, reference: str, max_n: int = 4) -> DataFrame:
    """A7 core, long form: per key and n, clipped n-gram matches and both
    totals (an order appears when either side has grams of that length)."""
    keys = list(keys)
    d = df.select(*keys, _overlap_column(F.col(candidate), F.col(reference), max_n).alias("_o"))
    out = d.select(*keys, F.inline("_o"))
    return out.where((F.col("cand_total") > 0) | (F.col("ref_total") > 0))


def _bleu_score(ps: list[Column], c_len: Column, r_len: Column) -> Column:
    """BLEU from per-order precisions: geometric mean (uniform weights) times
    the brevity penalty; 0 when some order has no match or the candidate is empty."""
    any_zero = F.greatest(*[p == 0 for p in ps])
    log_mean = sum((F.log(F.when(p > 0, p)) for p in ps), F.lit(0.0)) / len(ps)
    bp = F.when(c_len > r_len, F.lit(1.0)).otherwise(F.exp(1 - r_len / c_len))
    return F.when(any_zero | (c_len == 0), F.lit(0.0)).otherwise(bp * F.exp(log_mean))


def sentence_bleu(df: DataFrame, keys, candidate: str, reference: str, max_n: int = 4,
                  digits: int = 9) -> DataFrame:
    """Sentence BLEU per row, entirely in the row (no explode, no shuffle):
    uniform weights, brevity penalty, 0 when some order has no match. Pairs
    without any token are left out."""
    keys = list(keys)
    d = df.select(*keys, _overlap_column(F.col(candidate), F.col(reference), max_n).alias("_o"))
    first = F.col("_o")[0]
    ps = [F.coalesce(F.try_divide(F.col("_o")[n]["matches"], F.col("_o")[n]["cand_total"]), F.lit(0.0)) for n in range(max_n)]
    d = d.where((first["cand_total"] > 0) | (first["ref_total"] > 0))
    return d.select(*keys, F.round(_bleu_score(ps, first["cand_total"], first["ref_total"]), digits).alias("bleu"))


def bleu(overlap: DataFrame, keys, max_n: int = 4, digits: int = 9) -> DataFrame:
    """Sentence BLEU from a long-form ``ngram_overlap`` table (one
    aggregate per key); :func:`sentence_bleu` does the same in the row."""
    keys = list(keys)
    agg = [F.max(F.when(F.col("n") == n, F.try_divide("matches", "cand_total"))).alias(f"p{n}")
           for n in range(1, max_n + 1)]
    agg += [F.max(F.when(F.col("n") == 1, F.col("cand_total"))).alias("c_len"),
            F.max(F.when(F.col("n") == 1, F.col("ref_total"))).alias("r_len")]
    g = overlap.groupBy(*keys).agg(*agg)
    ps = [F.coalesce(F.col(f"p{n}"), F.lit(0.0)) for n in range(1, max_n + 1)]
    return g.select(*keys, F.round(_bleu_score(ps, F.col("c_len"), F.col("r_len")), digits).alias("bleu"))


def corpus_bleu(overlap: DataFrame, by=(), max_n: int = 4, digits: int = 9) -> DataFrame:
    """BLEU of all of a group's pairs as one text: clipped matches and totals of the
    long-form ``ngram_overlap`` are added up per order, then scored once."""
    by = list(by)
    sums = [F.sum(F.when(F.col("n") == n, F.col(c)).otherwise(0)).alias(f"{c}{n}") for n in range(1, max_n + 1)
            for c in ("matches", "cand_total", "ref_total")]
    g = overlap.groupBy(*by).agg(*sums)
    ps = [F.coalesce(F.try_divide(f"matches{n}", f"cand_total{n}"), F.lit(0.0)) for n in range(1, max_n + 1)]
    return g.select(*by, F.col("cand_total1").alias("cand_tokens"), F.col("ref_total1").alias("ref_tokens"),
                    F.round(_bleu_score(ps, F.col("cand_total1"), F.col("ref_total1")), digits).alias("bleu"))


def rouge_n(overlap: DataFrame, keys, n: int, digits: int = 9) -> DataFrame:
    """ROUGE-N recall / precision / F1 from ``ngram_overlap``."""
    o = overlap.where(F.col("n") == n)
    rec = F.when(F.col("ref_total") > 0, F.col("matches") / F.col("ref_total")).otherwise(0.0)
    prec = F.when(F.col("cand_total") > 0, F.col("matches") / F.col("cand_total")).otherwise(0.0)
    f1 = F.when(rec + prec > 0, 2 * rec * prec / (rec + prec)).otherwise(0.0)
    return o.select(*keys, F.round(rec, digits).alias("recall"), F.round(prec, digits).alias("precision"),
                    F.round(f1, digits).alias("f1"))


def leaderboard(scores: DataFrame, metric: str, by=("language",), entrant=("model", "prompt_name")) -> DataFrame:
    """Rank entrants per group by a metric (window over aggregated rows only)."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), *entrant)
    return scores.withColumn("rank", F.rank().over(w).cast("bigint"))


def json_string(c: Column) -> Column:
    """A Python ``json.dumps`` string literal (ensure_ascii: non-ASCII as
    \\uXXXX, surrogate pairs above the BMP), built natively."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for ch, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        esc = F.replace(esc, F.lit(ch), F.lit(rep))

    def u4(v: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(v)), 4, "0"))

    def enc(ch: Column) -> Column:
        cp = F.ascii(ch)
        hi = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)
        lo = F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(F.lit(0x3FF))
        return (F.when((cp < 0x20) | (cp > 0x7E) & (cp <= 0xFFFF), u4(cp))
                .when(cp > 0xFFFF, F.concat(u4(hi), u4(lo))).otherwise(ch))

    needs = F.regexp_like(esc, F.lit("[^\\x20-\\x7e]"))
    return F.concat(F.lit('"'), F.when(needs, F.array_join(F.transform(F.split(esc, ""), enc), ""))
                    .otherwise(esc), F.lit('"'))


def _json_number(c: Column) -> Column:
    """A double as Python's ``repr`` writes it, from its digits and exponent. The JVM may
    print 17 digits where 16 are enough, which is tried first; the smallest subnormal
    numbers keep its two digits."""
    text = F.abs(c).cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    # digits d1 d2 ... and the exponent of d1
    lead = F.regexp_replace(F.concat(whole, part), "^0+", "")
    exact = F.regexp_replace(lead, "0+$", "")
    down = F.substring(exact, 1, 16)
    up = (down.cast("bigint") + 1).cast("string")
    upward = F.substring(exact, 17, 1) >= "5"
    shorter = [F.when(upward, up).otherwise(down), F.when(upward, down).otherwise(up)]
    same = [F.concat(d, F.lit("E"), (power + F.length(whole) - 16 - F.length(F.concat(whole, part)) + F.length(lead)).cast("string")).cast("double") == F.abs(c)
            for d in shorter]
    digits = F.when(F.length(exact) < 17, exact).when(same[0], F.regexp_replace(shorter[0], "0+$", "")).when(
        same[1], F.regexp_replace(shorter[1], "0+$", "")).otherwise(exact)
    zeros = F.length(F.concat(whole, part)) - F.length(lead)
    exp = power + F.length(whole) - 1 - zeros
    n = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    large = F.when(n <= exp + 1, F.concat(digits, F.repeat(F.lit("0"), exp + 1 - n), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, n)))
    rest = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    far = F.concat(F.substring(digits, F.lit(1), F.lit(1)), rest, F.when(exp < 0, "e-").otherwise("e+"),
                   F.lpad(F.abs(exp).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exp).cast("string"))), F.lit("0")))
    body = F.when(digits == "", "0.0").when((exp < -4) | (exp >= 16), far).when(exp < 0, small).otherwise(large)
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    return (F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
            .otherwise(F.concat(sign, body)))


def canonical_json(c: Column, dtype: T.DataType) -> Column:
    """Python's ``json.dumps(x, sort_keys=True)`` of a value of any nesting of structs,
    maps with text keys, arrays, texts, whole numbers, doubles and booleans. Keys are
    sorted by code point at every level; other types are an error."""
    if isinstance(dtype, T.StructType):
        items = [F.concat(F.lit(json.dumps(f.name) + ": "), canonical_json(c[f.name], f.dataType))
                 for f in sorted(dtype.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))
    elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        items = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(json_string(k), F.lit(": "), canonical_json(c[k], dtype.valueType)))
        text = F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, dtype.elementType)), ", "), F.lit("]"))
    elif isinstance(dtype, T.StringType):
        text = json_string(c)
    elif isinstance(dtype, T.DoubleType):
        text = _json_number(c)
    elif isinstance(dtype, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    elif isinstance(dtype, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON form for {dtype.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(text)


def fingerprint(fields: dict[str, Column]) -> Column:
    """md5 of ``json.dumps(d, sort_keys=True)`` for a flat record of
    strings and integers (Python's ", " and ": " separators)."""
    parts = []
    for k in sorted(fields):
        v = fields[k]
        parts.append(F.concat(F.lit(f'"{k}": '), v))
    return F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def fingerprint_rows(df: DataFrame, *columns: str) -> Column:
    """md5 of the canonical JSON of a row's columns (default: all), however nested."""
    fields = [df.schema[c] for c in (columns or df.columns)]
    return F.md5(canonical_json(F.struct(*[F.col(f"`{f.name}`") for f in fields]), T.StructType(fields)))


def score_join(predictions: DataFrame, problems: DataFrame, keys=("task_id",), salts: int = 1) -> DataFrame:
    """Predictions joined with their problems on the task key.

    The optimizer picks the join from measured bytes (a small benchmark is
    broadcast), and AQE splits a skewed task. ``salts`` over 1 spreads each task
    by hand where AQE is off: predictions get a salt, problems one row per salt."""
    keys = list(keys)
    if salts == 1:
        return predictions.join(problems, keys, "inner")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(int(salts))).cast("int")
    spread = problems.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))))
    return predictions.withColumn("_salt", salt).join(spread, [*keys, "_salt"]).drop("_salt")
