"""Collocations from depth-truncated suffix subtrees, partitioned vertically by memory.

Texts are read three times. First the words of each language are counted, then the pairs
of adjacent words that are frequent themselves. The frequent pairs are the word prefixes:
their counts are added up in hash order and cut into groups of at most ``budget``
occurrences. In the last reading every position that starts with a frequent pair gives
its suffix, truncated to five words and at the first infrequent pair, to the group of its
prefix. Each group is one task, which sorts its suffixes into a subtree and reads the
count of each phrase as the total of the leaves below it (ERA, Mansour et al., 2011).

A prefix of more than ``budget`` occurrences is spread over several groups by its whole
suffix; the subtrees' partial counts are added up afterwards. Equal suffixes are counted
where they are read, so a passage that stands everywhere is a few rows.

Words travel as 64-bit hashes; the hashes of the words are checked against each other,
and another salt is taken if a frequent word's hash is also another word's, so counts are
exact. Bit tables of fixed size tell which words and pairs may be frequent. They only
keep suffixes short: a bit set by another word or pair makes a subtree larger, and its
phrases are dropped by their counts.

Defined cases: a null text is empty, a null language is ``und``; words keep all but A-Z
as it is; repeated rows count as often as they stand; an empty table has no phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codepref.llm.common import materialize, running_total

#: Least occurrences, words at most and phrases returned per language.
LEAST, DEPTH, TOP = 100, 5, 2000
#: Occurrences in a group of prefixes, at most (but for what one hash range holds).
BUDGET = 2_000_000
#: The bit tables have 2 ** BITS bits (8 MB).
BITS = 26
#: Bytes of text taken apart at once, and entries gathered before they are sent on.
CHUNK, GATHER = 2_000_000, 2_000_000
#: Word tables of at most so many rows are broadcast, else joined.
BROADCAST_ROWS = 200_000

TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D][\x20\x09.,;:!?\x0A-\x0D]*")
BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
BREAKS = frozenset(b".,;:!?\n\v\f\r")


class Codes(dict):
    """Numbers words as they come; number 0 is a break. A code's hash is the word's, or 0
    where the bit table does not hold it."""

    def __init__(self, seed: int, table: np.ndarray | None = None):
        self.seed, self.table, self.n = seed, table, 1
        self.new: list[bytes] = []
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        if word[0] in BREAKS:
            self[word] = 0
            return 0
        self.new.append(word)
        self[word] = code = self.n
        self.n += 1
        return code

    def read(self, text: bytes) -> np.ndarray:
        """The codes of a text's words and breaks."""
        return np.fromiter(map(self.__getitem__, TOKEN.findall(text)), np.int64)

    def frequent(self, text: bytes) -> np.ndarray:
        """The hashes of a text's words; 0 for breaks and words that are not frequent."""
        code = self.read(text)
        if self.new:
            h = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in self.new], np.uint64)
            self.hashes = np.append(self.hashes, np.where(_held(self.table, h), h, np.uint64(0)))
            self.new.clear()
        return self.hashes[code]


def seed_of(lang: bytes, salt: int) -> int:
    """The seed of a language's words: Spark's xxhash64(lang, salt, word) chains them."""
    return xxhash.xxh64_intdigest(str(salt).encode(), xxhash.xxh64_intdigest(lang, 42))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """(lang, text) of bounded size: texts of one language joined, cut at breaks."""
    by_lang: dict[bytes, list[bytes]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
        by_lang.setdefault(lang, []).append(text)
    for lang, texts in by_lang.items():
        held, size = [], 0
        for text in texts:
            at = 0
            while at < len(text):
                end = at + CHUNK - size
                cut = BREAK.search(text, end) if end < len(text) else None
                end = cut.end() if cut else len(text)
                held.append(text[at:end])
                size += end - at
                at = end
                if size >= CHUNK:
                    yield lang, b"\n".join(held).lower()
                    held, size = [], 0
        if held:
            yield lang, b"\n".join(held).lower()


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    def count(batches):
        coders: dict[bytes, Codes] = {}
        totals: dict[bytes, np.ndarray] = {}

        def rows():
            for lang, codes in coders.items():
                words = [(w, c) for w, c in codes.items() if c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.decode()] * len(words), pa.string()), pa.array([w.decode() for w, _ in words], pa.string()),
                     pa.array(totals[lang][[c for _, c in words]], pa.int64())], ["lang", "word", "f"])
            coders.clear()
            totals.clear()

        for batch in batches:
            for lang, text in _pieces(batch):
                codes = coders.setdefault(lang, Codes(0))
                n = np.bincount(codes.read(text), minlength=codes.n)
                if lang in totals:
                    n[:len(totals[lang])] += totals[lang]
                totals[lang] = n
                if sum(map(len, coders.values())) > GATHER // 4:
                    yield from rows()
        yield from rows()

    return _read(docs).mapInArrow(count, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def hashed(words: DataFrame, least: int) -> tuple[int, DataFrame]:
    """A salt, and the frequent words (lang, word, f, h) with hashes that no other word has."""
    for salt in range(100):
        h = words.withColumn("h", F.xxhash64("lang", F.lit(str(salt)), "word"))
        shared = h.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f")).where(((F.col("n") > 1) | (F.col("h") == 0)) & (F.col("f") >= least))
        if shared.isEmpty():
            return salt, materialize(h.where(F.col("f") >= least))
    raise RuntimeError("no salt keeps the words' hashes apart")


def bit_table(keys: DataFrame) -> np.ndarray:
    """The 2 ** BITS bits of the hashes in a column ``h``: a table of fixed size."""
    at = F.shiftrightunsigned("h", 64 - BITS)
    held = keys.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(%s & 63 as int))" % f"shiftrightunsigned(h, {64 - BITS})").alias("v"))
    got = held.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at most 2 ** BITS / 64 rows
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[got["w"].to_numpy()] = got["v"].to_numpy()
    return table


def _held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sent(group: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per group with its part of each column, in bytes."""
    order = np.argsort(group, kind="stable")
    group, columns = group[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(cuts[1:], len(group))
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(group[cuts], pa.int64()), pa.array(ends - cuts, pa.int64()), pa.array(blobs, pa.binary())],
                                      ["grp", "n", "data"])


SENT = "grp bigint, n bigint, data binary"


def _received(table: pa.Table, width: int) -> list[np.ndarray]:
    """The columns of all of a group's rows, as 64-bit words."""
    parts = [np.frombuffer(d, np.uint64).reshape(width, n) for n, d in zip(table["n"].to_pylist(), table["data"].to_pylist())]
    return list(np.concatenate(parts, axis=1))


def frequent_pairs(docs: DataFrame, salt: int, words: np.ndarray, parts: int, least: int) -> DataFrame:
    """(h, f) of the hashed pairs of frequent words that occur often."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(words)

    def pairs(batches):
        held, size, coders = [], 0, {}

        def rows():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            yield _sent((key % np.uint64(parts)).astype(np.int64), key, n.astype(np.uint64))

        for batch in batches:
            for lang, text in _pieces(batch):
                codes = coders.setdefault(lang, Codes(seed_of(lang, salt), table.value))
                h = codes.frequent(text)
                if len(codes) > GATHER // 8:
                    del coders[lang]
                a, b = h[:-1], h[1:]
                both = (a != 0) & (b != 0)
                held.append(_pair(a[both], b[both]))
                size += len(held[-1])
                if size > GATHER:
                    yield from rows()
                    held, size = [], 0
        if size:
            yield from rows()

    def add(got):
        key, n = _received(got, 2)
        order = np.argsort(key)
        key, n = key[order], n[order]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(n, cuts)
        many = total >= least
        return pa.table({"h": key[cuts][many].view(np.int64), "f": total[many].astype(np.int64)})

    return _read(docs).mapInArrow(pairs, SENT).groupBy("grp").applyInArrow(add, "h bigint, f bigint")


def prefix_groups(pairs: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes' groups: the hash at which each group starts, and the prefixes of more
    than ``budget`` occurrences with the number of groups each is spread over. Both have
    at most about as many entries as there are groups."""
    heavy = pairs.where(F.col("f") > budget).select("h", F.ceil(F.col("f") / budget).cast("bigint").alias("k")).toArrow()
    light = pairs.where(F.col("f") <= budget)
    total = light.agg(F.sum("f")).first()[0] or 0
    # ranges of the hash far finer than a group, in the hash's unsigned order
    bits = min(40, max(4, int(total // budget * 16 + 1).bit_length()))
    fine = F.shiftrightunsigned("h", 64 - bits)
    sums = light.groupBy(fine.alias("at")).agg(F.sum("f").alias("f"))
    placed = running_total(sums, [], ["at"], "f", "upto").select("at", F.expr(f"(upto - 1) div {budget}").alias("g"))
    starts = np.sort(placed.groupBy("g").agg(F.min("at").alias("at")).toArrow()["at"].to_numpy().astype(np.uint64))
    h = heavy["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return starts << np.uint64(64 - bits), h[order], heavy["k"].to_numpy()[order]


def subtrees(docs: DataFrame, salt: int, words: np.ndarray, pairs: np.ndarray, groups, least: int, depth: int) -> DataFrame:
    """(words, f): the hashes of the words of each phrase of 2 to ``depth`` words, and its
    occurrences (in one group, if its prefix is spread over several)."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast((words, pairs, *groups))

    def suffixes(batches):
        words, pairs, starts, heavy, spread = known.value
        held, size, coders = [], 0, {}

        def rows():
            cols = [np.concatenate(c) for c in zip(*held)]
            key = cols[0].copy()
            for c in cols[1:]:
                key = _pair(key, c)
            # equal suffixes become one row: sorted by a hash, then compared in full
            order = np.lexsort((*cols[::-1], key))
            cols, key = [c[order] for c in cols], key[order]
            new = np.zeros(len(key), bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(new)
            n = np.diff(np.append(cuts, len(key))).astype(np.uint64)
            cols, key = [c[cuts] for c in cols], key[cuts]
            prefix = _pair(cols[0], cols[1])
            group = np.searchsorted(starts, prefix, "right") - 1
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, prefix), len(heavy) - 1)
                part = len(starts) + (np.cumsum(spread) - spread)[at] + (key % spread[at].astype(np.uint64)).astype(np.int64)
                group = np.where(heavy[at] == prefix, part, group)
            yield _sent(np.maximum(group, 0), *cols, n)

        for batch in batches:
            for lang, text in _pieces(batch):
                codes = coders.setdefault(lang, Codes(seed_of(lang, salt), words))
                h = np.append(codes.frequent(text), np.zeros(depth, np.uint64))
                if len(codes) > GATHER // 8:
                    del coders[lang]
                a, b = h[:-1], h[1:]
                tied = np.append((a != 0) & (b != 0) & _held(pairs, _pair(a, b)), False)
                at = np.flatnonzero(tied)
                cols, on = [h[at]], np.ones(len(at), bool)
                for d in range(1, depth):
                    on = on & tied[at + d - 1]
                    cols.append(np.where(on, h[np.minimum(at + d, len(h) - 1)], np.uint64(0)))
                held.append(cols)
                size += len(at)
                if size > GATHER // 2:
                    yield from rows()
                    held, size = [], 0
        if size:
            yield from rows()

    whole = len(groups[0])  # the groups after these hold parts of prefixes

    def subtree(key, got):
        *cols, n = _received(got, depth + 1)
        order = np.lexsort(cols[::-1])
        cols, n = [c[order] for c in cols], n[order]
        differs, out, counts = np.zeros(len(n), bool), [], []
        differs[0] = True
        for d in range(depth):
            differs[1:] |= cols[d][1:] != cols[d][:-1]
            cuts = np.flatnonzero(differs)
            total = np.add.reduceat(n, cuts)
            good = cols[d][cuts] != 0
            if key[0].as_py() < whole:
                good &= total >= least
            if d:
                nodes = np.stack([c[cuts[good]].view(np.int64) for c in cols[:d + 1]], axis=1)
                out.append(pa.ListArray.from_arrays(np.arange(0, nodes.size + 1, d + 1, dtype=np.int32), nodes.ravel()))
                counts.append(total[good].astype(np.int64))
        return pa.table({"words": pa.chunked_array(out), "f": np.concatenate(counts)})

    found = _read(docs).mapInArrow(suffixes, SENT).groupBy("grp").applyInArrow(subtree, "words array<bigint>, f bigint")
    return found.groupBy("words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrase_counts(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """The words per language (lang, n), and all frequent words and phrases with
    (lang, words, f), words an array of strings."""
    words = materialize(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    salt, frequent = hashed(words, least)
    total = words.agg(F.sum("f")).first()[0] or 0
    in_words = bit_table(frequent)
    pairs = materialize(frequent_pairs(docs, salt, in_words, int(total // budget) + 1, least))
    groups = prefix_groups(pairs, budget)
    nodes = materialize(subtrees(docs, salt, in_words, bit_table(pairs), groups, least, depth))
    names = frequent.select("h", "lang", "word")
    names = F.broadcast(names) if frequent.count() <= BROADCAST_ROWS else names
    # by phrase the words in order; a phrase's words are of one language
    each = nodes.select("words", "f", F.posexplode("words").alias("pos", "h")).join(names, "h")
    named = each.groupBy("words").agg(F.first("lang").alias("lang"), F.first("f").alias("f"),
                                      F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    phrases = named.where(F.size("w") == F.size("words")).select("lang", F.col("w.word").alias("words"), "f")
    return totals, materialize(phrases.unionByName(frequent.select("lang", F.array("word").alias("words"), "f")))


def collocations(docs: DataFrame, top: int = TOP, **settings) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    totals, counts = phrase_counts(docs, **settings)
    size = F.size("words")
    candidates = counts.where(size > 1)
    # a longer phrase that is as frequent holds one of a word more that is as well
    inner = candidates.where(size > 2).select("lang", "f", F.explode(F.array(
        F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"))
    covered = inner.groupBy("lang", "words").agg(F.max("f").alias("above"))
    kept = candidates.join(covered, ["lang", "words"], "left").where("above is null or above < f")
    cut = kept.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    side = lambda name, out: counts.select("lang", F.col("words").alias(name), F.col("f").alias(out))
    cut = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cut = cut.join(F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cut.withColumn("whole", F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(14,0)")).withColumn(
        "parts", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("whole div parts"))
    best = scored.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    rows = best.select("lang", F.array_join("words", " ").alias("phrase"), "b.a", "b.l", "b.r", "b.n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
