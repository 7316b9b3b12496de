"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes. Escapes are estimated
by absolute discounting (each of the d followers of a context seen n times gives up
``DISCOUNT`` of a count: a follower seen c times has (c - DISCOUNT) / n, the escape
DISCOUNT * d / n), and a symbol that a longer context offers is excluded from the
shorter ones. A text's score is the log10 probability of its byte stream: its
words in lower case, one space between, and an end byte; contexts start as end
bytes.

Pretrained (``score``): the trie is counted over all training texts in one Spark
aggregation of (ORDER + 1)-byte strings; all shorter contexts are sums of these.
Because what a context offers, its suffix offers too, the exclusion set at a
context is what the next longer seen context offers, so each node needs only a
few sums, and a string of bytes has one fixed probability. Tasks get the trie in
slices of at most ``SLICE`` strings (whole subtrees of 2-byte suffixes); with more
than one slice, each is a pass over the texts that adds up its positions.

Adaptive (``adaptive_score``): each text alone, learning as it goes.

Word unigram base: words outside the ``TOP`` most frequent ones are looked up by
a join with the whole count table, so tables of any size work.

Defined cases: a null text counts as empty (its stream is the end byte); repeated
rows are scored alike; without training texts every byte has probability 1/256.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codepref.llm.common import crc_mod, materialize
from codepref.llm.simhash import words

ORDER = 5
DISCOUNT = 0.3
END = b"\n"  # no word holds it
#: Bounds of what a task holds of the model: strings of a slice, frequent words.
SLICE = 4_000_000
TOP = 200_000
PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)  # Fixed value: Fibonacci hashing


def stream(text: str | None) -> bytes:
    return b" ".join(words(text)) + END


def pieces(streams: Iterable[bytes], order: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of about PIECE bytes: (stream numbers, starts, keys, valid). A key
    is the order + 1 bytes that end at a position; long streams are cut, with the
    context of each cut kept."""
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def group():
        raw = np.frombuffer(b"".join(held), dtype=np.uint8).astype(np.uint64)
        starts = np.cumsum([0, *map(len, held[:-1])])
        keys = raw.copy()
        for k in range(1, order + 1):
            keys[k:] |= raw[:-k] << np.uint64(8 * k)
        valid = np.ones(len(raw), dtype=bool)
        valid[(starts[:, None] + np.arange(order)).ravel()] = False
        return owner, starts, keys, valid

    for i, s in enumerate(streams):
        padded = END * order + s
        for a in range(0, len(s), PIECE):
            held.append(padded[a:a + PIECE + order])
            owner.append(i)
            size += len(held[-1])
            if size >= PIECE:
                yield group()
                held, owner, size = [], [], 0
    if held:
        yield group()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _text(batch: pa.RecordBatch) -> list:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def string_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n): how often each string of order + 1 bytes occurs, over all texts.
    Each task sums its own first and sends each string once or a few times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(keys, n):
            for a in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + (1 << 17)].astype(np.int64)),
                                                  pa.array(n[a:a + (1 << 17)])], ["key", "n"])

        for batch in batches:
            for _, _, keys, valid in pieces(map(stream, _text(batch)), order):
                held.append(np.unique(keys[valid], return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*_summed(*map(np.concatenate, zip(*held))))

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "key bigint, n bigint")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """A slice of the trie as arrays. Per order k: sorted strings (context and
    symbol) with counts, and sorted contexts with their sums."""
    order: int
    strings: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    sums: list[np.ndarray]  # columns: n, d, and what is left of both to the parent after exclusion
    bucket: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, n: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, order: int) -> Trie:
        """``keys``: this slice's strings of order + 1 bytes; ``pairs``: the whole
        corpus' strings of 2 bytes, for the contexts that slices share."""
        strings, counts, contexts, sums = [], [], [], []
        for k in range(order + 1):
            width = np.uint64((1 << 8 * (k + 1)) - 1)
            s, c = _summed(pairs & width, pair_n) if k < 2 else _summed(keys & width, n)
            ctx, first = np.unique(s >> np.uint64(8), return_index=True)
            total = np.add.reduceat(c, first) if len(first) else c
            kinds = np.diff(np.r_[first, len(s)])
            left = np.zeros((len(ctx), 2))
            if k and len(ctx):
                parent = np.searchsorted(strings[-1], s & np.uint64((1 << 8 * k) - 1))
                gone = np.add.reduceat(counts[-1][parent], first)
                up = sums[-1][np.searchsorted(contexts[-1], ctx & np.uint64((1 << 8 * (k - 1)) - 1))]
                left[:, 1] = up[:, 1] - kinds
                left[:, 0] = up[:, 0] - gone
            strings.append(s)
            counts.append(c)
            contexts.append(ctx)
            sums.append(np.c_[total, kinds, left].astype(np.float64).reshape(-1, 4))
        top, c = strings[order], counts[order]
        at = np.searchsorted(contexts[order], top >> np.uint64(8))
        logs = np.log10((c - DISCOUNT) / sums[order][at, 0])
        bits = max(8, int(max(1, len(top))).bit_length() + 1)
        slot = (top * _MIX) >> np.uint64(64 - bits)
        rank = np.argsort(slot, kind="stable")
        bucket = np.r_[0, np.cumsum(np.bincount(slot.astype(np.int64), minlength=1 << bits))].astype(np.int32)
        return cls(order, strings, counts, contexts, sums, bucket, top[rank], logs[rank])

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last byte after the bytes before it."""
        out = np.full(len(keys), np.nan)
        if len(self.keys):
            bits = (len(self.bucket) - 1).bit_length() - 1
            slot = ((keys * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
            at, end = self.bucket[slot], self.bucket[slot + 1]
            todo = np.flatnonzero(at < end)
            at, end = at[todo], end[todo]
            while len(todo):
                hit = self.keys[at] == keys[todo]
                out[todo[hit]] = self.values[at[hit]]
                more = ~hit & (at + 1 < end)
                todo, at, end = todo[more], at[more] + 1, end[more]
        miss = np.flatnonzero(np.isnan(out))
        if len(miss):
            unique, inverse = np.unique(keys[miss], return_inverse=True)
            out[miss] = self._escaped(unique)[inverse]
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        """The same by walking down the orders."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        den, esc = np.full(len(keys), np.nan), np.full(len(keys), np.nan)  # of the order below, once a context was seen
        for k in range(self.order, -1, -1):
            if not len(self.contexts[k]) or not len(todo):
                continue
            key = keys[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            ctx = key >> np.uint64(8)
            i = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            seen = self.contexts[k][i] == ctx
            row = self.sums[k][i]
            fresh = np.isnan(den[todo])
            d = np.where(fresh, row[:, 0], den[todo])
            e = np.where(fresh, row[:, 1], esc[todo]) * DISCOUNT
            j = np.minimum(np.searchsorted(self.strings[k], key), len(self.strings[k]) - 1)
            found = seen & (self.strings[k][j] == key)
            out[todo[found]] += np.log10((self.counts[k][j[found]] - DISCOUNT) / d[found])
            away = seen & ~found
            real = away & (d > 0)  # a context with nothing left to offer is passed over
            out[todo[real]] += np.log10(e[real] / d[real])
            den[todo[away]], esc[todo[away]] = row[away, 2], row[away, 3]
            todo = todo[~found]
        kinds = self.sums[0][0, 1] if len(self.sums[0]) else 0
        out[todo] -= math.log10(max(1, 256 - kinds))
        return out


def _slices(strings: DataFrame, limit: int) -> list[np.ndarray | None]:
    """The 2-byte suffixes of each slice: whole subtrees, packed up to ``limit``
    strings. One slice of all is None. The table read has at most 65,536 rows."""
    sizes = strings.groupBy(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("suffix")).count()
    found = sorted((r["suffix"], r["count"]) for r in sizes.collect())
    if sum(n for _, n in found) <= limit:
        return [None]
    out, held, size = [], [], 0
    for suffix, n in found:
        if held and size + n > limit:
            out.append(np.array(held))
            held, size = [], 0
        held.append(suffix)
        size += n
    rest = sorted(set(range(1 << 16)) - {s for s, _ in found})  # unseen suffixes go with the last slice
    return [*out, np.array(held + rest)]


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("key", "n").toArrow()
    return t["key"].to_numpy().astype(np.uint64), t["n"].to_numpy().astype(np.int64)


def frequent_words(counts: DataFrame, top: int) -> dict[bytes, int]:
    """Words and counts from the smallest count on that at most ``top`` words reach
    (to a sixteenth of a power of two), so no task sorts or sends all words."""
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r["s"], r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    least, held = None, 0
    for s, n in steps:
        held += n
        if held > top:
            break
        least = s
    if least is None:
        return {}
    t = counts.where(step >= least).select("word", "n").toArrow()
    return dict(zip(t["word"].to_pylist(), t["n"].to_pylist()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end counted as a word of its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            items = list(held.items())
            for a in range(0, len(items), 1 << 16):
                part = items[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()),
                                                  pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for batch in batches:
            for t in _text(batch):
                held.update(words(t))
                held[END] += 1
                if len(held) > 1_000_000:
                    yield from out()
                    held.clear()
        yield from out()

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
_BASE = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()),
                   ("rare", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))])


def score(docs: DataFrame, train: DataFrame, order: int = ORDER, limit: int = SLICE, top: int = TOP) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of
    ``docs``, with the model of all texts of ``train``."""
    sc = docs.sparkSession.sparkContext
    strings = materialize(string_counts(train, order))
    pairs = _arrays(strings.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")))
    counts = materialize(word_counts(train))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = frequent_words(counts, top)
    logs = sc.broadcast({w: math.log10(n + 1) for w, n in often.items()})
    everything = len(often) == kinds
    slices = _slices(strings, limit)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    if len(slices) > 1:
        rows = materialize(rows)

    def base(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = logs.value
        out = []
        for row, text in zip(batch.column(0).to_pylist(), _text(batch)):
            w = words(text)
            w.append(END)
            n, total_log, hits, rare = len(w), 0.0, 0, []
            for word, tf in Counter(w).items():
                value = known.get(word)
                if value is not None:
                    total_log += tf * value
                    hits += tf
                elif not everything:
                    rare.append({"word": word, "tf": tf})
            out.append({"row": row, "n_tokens": n, "known": hits, "logs": total_log, "rare": rare})
        return pa.RecordBatch.from_pylist(out, _BASE)

    def passes(trie, mine: np.ndarray | None, with_base: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = trie.value
            inside = None
            if mine is not None:
                inside = np.zeros(1 << 16, dtype=bool)
                inside[mine] = True
            for big in batches:
                for a in range(0, big.num_rows, 1000):
                    batch = big.slice(a, 1000)
                    sums = np.zeros(batch.num_rows)
                    for owner, starts, keys, valid in pieces(map(stream, _text(batch)), t.order):
                        if inside is not None:
                            valid &= inside[((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
                        at = np.flatnonzero(valid)
                        value = np.zeros(len(keys))
                        value[at] = t.log10(keys[at])
                        np.add.at(sums, owner, np.add.reduceat(value, starts))
                    cols = [batch.column(0), batch.column(1), pa.array(sums)]
                    if with_base:
                        cols += base(batch).columns[1:]
                    yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([*_PART, *(list(_BASE)[1:] if with_base else [])]))
        return run

    parts = []
    for i, mine in enumerate(slices):
        held = strings
        if mine is not None:
            ids = docs.sparkSession.createDataFrame([(int(s),) for s in mine], "suffix int")
            held = strings.join(F.broadcast(ids), F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)) == F.col("suffix"))
        trie = sc.broadcast(Trie.build(*_arrays(held), *pairs, order))
        schema = "row bigint, doc_id bigint, score double"
        if i == 0:
            schema += ", n_tokens bigint, known bigint, logs double, rare array<struct<word:binary,tf:bigint>>"
        parts.append(materialize(rows.mapInArrow(passes(trie, mine, i == 0), schema)))
    scored = parts[0]
    if len(parts) > 1:
        sums = reduce(DataFrame.unionByName, [p.select("row", "score") for p in parts]).groupBy("row").agg(F.sum("score").alias("score"))
        scored = scored.drop("score").join(sums, "row")
    # the words outside the frequent ones meet the whole count table
    named = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.tf").join(counts, "word")
    added = named.groupBy("row").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more_logs"))
    whole = scored.drop("rare").join(added, "row", "left")
    space = math.log10(total + kinds + 1)
    return whole.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(space)).alias("base_score"), "score")


def adaptive_log10(data: bytes, order: int = ORDER) -> float:
    """log10 probability of ``data`` by a model that starts empty and learns each
    byte after it is scored."""
    nodes: dict[bytes, Counter] = {}
    padded, out = END * order + data, 0.0
    for i in range(order, len(padded)):
        byte, excluded, p = padded[i], frozenset(), 0.0
        for k in range(order, -1, -1):
            node = nodes.get(padded[i - k:i])
            if not node:
                continue
            left = {b: n for b, n in node.items() if b not in excluded}
            den = sum(left.values())
            if byte in left:
                p += math.log10((left[byte] - DISCOUNT) / den)
                break
            if den:
                p += math.log10(DISCOUNT * len(left) / den)
            excluded = frozenset(node)
        else:
            p -= math.log10(256 - len(excluded))
        out += p
        for k in range(order + 1):
            nodes.setdefault(padded[i - k:i], Counter())[byte] += 1
    return out


def adaptive_score(docs: DataFrame, order: int = ORDER, out: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([adaptive_log10(stream(t), order) for t in texts], dtype=float)

    return docs.withColumn(out, run(F.col("text").cast("string")))


def held_out(fold: int = 7, held: int = 2):
    return crc_mod(F.col("doc_id"), fold) == held
