"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: each block of documents keeps, for every
test term, the sorted positions at which the block holds it (documents lie one
after another with a gap that no window spans). It is one written table; a row is
a block, of bounded size. A search takes each window of consecutive test words,
orders its terms by how often the whole corpus holds them, and intersects their
position lists, each shifted by the term's place in the window, from the rarest
term on; what survives is an exact phrase. With ``slack`` over 0 a term may also
lie up to that many words from its place: a proximity match.

Test items come in blocks of at most ``BLOCK_BYTES`` of text, one search each
against all documents, so the broadcast side stays bounded for any test set.

Defined cases: null or wordless texts have no words, windows or matches; repeated
items with one id act as one item with all their windows; null item ids are left
out; repeated documents are each searched and reported.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codepref.llm.common import hash60, materialize

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Text bytes of one block of the index.
INDEX_BYTES = 12 << 20

# Bytes that are not part of a word become spaces, A-Z lower case.
_GAPS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_WORDS = bytearray(range(256))
_WORDS[0x41:0x5B] = bytes(range(0x61, 0x7B))
for _b in _GAPS:
    _WORDS[_b] = 0x20
_WORDS = bytes(_WORDS)

INDEX = pa.schema([("block", pa.string()), ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
                   ("starts", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
                   ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("positions", pa.binary())])
MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("exact", pa.bool_())])
FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(MATCH))])
INDEX_SCHEMA = ("block string, rows array<bigint>, doc_ids array<bigint>, starts array<bigint>, "
                "n_words array<bigint>, terms array<binary>, counts array<bigint>, positions binary")
FOUND_SCHEMA = ("row bigint, doc_id bigint, n_words bigint, "
                "matches array<struct<item_id:bigint,start:bigint,length:bigint,exact:boolean>>")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def windows(items: list[tuple[int, str | None]], size: int = WINDOW) -> dict[tuple[bytes, ...], list[int]]:
    """Each distinct window of words with the items that hold it."""
    out: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            for i in range(max(1, len(w) - size + 1)):
                out[tuple(w[i:i + size])].add(item)
    return {k: sorted(v) for k, v in out.items()}


def _block(block: str, docs: list[tuple], terms: list[bytes], number: dict[bytes, int], gap: int) -> dict:
    tokens = [words(t) for _, _, t in docs]
    n = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    starts = np.cumsum(n + gap) - (n + gap)
    place, get = [], number.get
    for w, s in zip(tokens, starts):
        term = np.fromiter((get(x, -1) for x in w), dtype=np.int64, count=len(w))
        at = np.flatnonzero(term >= 0)
        place.append((term[at] << 32) | (at + s))
    both = np.sort(np.concatenate(place))
    which, first, counts = np.unique(both >> 32, return_index=True, return_counts=True)
    at = both & 0xFFFFFFFF
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]  # each list starts anew
    return {"block": block, "rows": [r for r, _, _ in docs], "doc_ids": [i for _, i, _ in docs], "starts": starts,
            "n_words": n, "terms": [terms[i] for i in which], "counts": counts,
            "positions": steps.astype("<u4").tobytes()}


def build_index(docs: DataFrame, vocabulary: list[bytes], gap: int = WINDOW + 1,
                block_bytes: int = INDEX_BYTES) -> DataFrame:
    """The postings of the given terms in every whole text of (row, doc_id, text):
    one written row per block."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        number = {t: i for i, t in enumerate(terms)}
        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(doc)
                size += len(doc[2] or "")
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([_block(f"{part}-{k}", held, terms, number, gap)], INDEX)
                    held, size, k = [], 0, k + 1
        if held:
            yield pa.RecordBatch.from_pylist([_block(f"{part}-{k}", held, terms, number, gap)], INDEX)

    return materialize(docs.select("row", "doc_id", "text").mapInArrow(index, INDEX_SCHEMA))


def term_counts(index: DataFrame) -> DataFrame:
    """How often the corpus holds each test term."""
    lists = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return lists.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))


def _intersect(lists: dict[bytes, np.ndarray], window: tuple[bytes, ...], order: np.ndarray) -> np.ndarray:
    """Starts of the window's exact occurrences: offset-adjusted lists from the rarest term on."""
    starts = lists[window[order[0]]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        other, want = lists[window[k]], starts + k
        at = np.minimum(np.searchsorted(other, want), len(other) - 1)
        starts = starts[other[at] == want]
    return starts


def _nearby(lists: dict[bytes, np.ndarray], window: tuple[bytes, ...], order: np.ndarray, slack: int):
    """(first, last) positions where every term lies within ``slack`` words of its place."""
    anchor = lists[window[order[0]]]
    low, high = anchor.copy(), anchor.copy()
    for k in order[1:]:
        other, want = lists[window[k]], anchor + (k - order[0])
        right = np.minimum(np.searchsorted(other, want), len(other) - 1)
        left = np.maximum(right - 1, 0)
        near = np.where(np.abs(other[left] - want) <= np.abs(other[right] - want), other[left], other[right])
        ok = np.abs(near - want) <= slack
        anchor, near, low, high = anchor[ok], near[ok], low[ok], high[ok]
        low, high = np.minimum(low, near), np.maximum(high, near)
        if not len(anchor):
            break
    return low, high


def _runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as maximal runs (first, length)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return [(int(a), int(b - a)) for a, b in zip(s[cut], e[np.r_[cut[1:] - 1, len(s) - 1]])]


def _search_block(block: dict, wanted: list[tuple[tuple[bytes, ...], np.ndarray, list[int]]], slack: int) -> list[dict]:
    counts = np.asarray(block["counts"], dtype=np.int64)
    ends = np.cumsum(counts)
    steps = np.frombuffer(block["positions"], dtype="<u4").astype(np.int64)
    lists = {t: np.cumsum(steps[e - c:e]) for t, c, e in zip(block["terms"], counts, ends)}
    starts = np.asarray(block["starts"], dtype=np.int64)
    spans: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    for window, order, items in wanted:
        if all(t in lists for t in window):
            s = _intersect(lists, window, order)
            kinds = [(s, s + len(window), True)]
            if slack:
                low, high = _nearby(lists, window, order, slack)
                kinds.append((low, high + 1, False))
            for s, e, exact in kinds:
                if len(s):
                    for item in items:
                        spans[item, exact].append((s, e))
    found: list[list[dict]] = [[] for _ in starts]
    for (item, exact), parts in sorted(spans.items()):
        for s, length in _runs(*map(np.concatenate, zip(*parts))):
            d = int(np.searchsorted(starts, s, side="right")) - 1
            found[d].append({"item_id": item, "start": s - int(starts[d]), "length": length, "exact": exact})
    return [{"row": r, "doc_id": i, "n_words": n, "matches": m}
            for r, i, n, m in zip(block["rows"], block["doc_ids"], block["n_words"], found)]


def search(index: DataFrame, wins: dict[tuple[bytes, ...], list[int]], slack: int = 0) -> DataFrame:
    """All documents with their matches: maximal runs of matched words per item,
    from the document's first word on (0). ``exact`` runs are made of phrases,
    the others of proximity matches (only with ``slack`` over 0)."""
    # at most the terms of one block of test items
    often = {bytes(r["term"]): r["n"] for r in term_counts(index).collect()}
    wanted = [(w, np.array(sorted(range(len(w)), key=lambda k: (often[w[k]], k))), items)
              for w, items in wins.items() if all(t in often for t in w)]
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(_search_block(block, shared.value, slack), FOUND)

    return index.mapInArrow(look, FOUND_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = 0,
                  block_bytes: int = BLOCK_BYTES, row: str | None = None) -> DataFrame:
    """(doc_id, n_words, matches) per row of ``docs``; with ``row``, a column that
    numbers the rows, also that column. Where the test items fill
    several blocks, the documents are written once with row numbers and each
    one's matches are gathered over the blocks."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    rows = rows if n == 1 else materialize(rows)
    found = []
    for k in range(n):
        held = [(r["item_id"], r["text"]) for r in items.where(hash60(F.col("item_id"), ":block") % n == k).collect()]
        wins = windows(held, size)
        index = build_index(rows, sorted({t for w in wins for t in w}), size + 2 * slack + 1)
        found.append(search(index, wins, slack))
    out = found[0] if n == 1 else (
        reduce(DataFrame.unionByName, found).groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
             F.flatten(F.collect_list("matches")).alias("matches")))
    return out.withColumnRenamed("row", row) if row else out.drop("row")


def digest(found: DataFrame) -> DataFrame:
    """Counts and item digest per document from its matches."""
    exact = F.filter("matches", lambda m: m["exact"])
    spans = F.array_sort(F.transform(exact, lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["length"]).alias("e"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("e"))
    hit = F.aggregate(spans, zero, lambda a, m: F.struct(
        (a["n"] + F.greatest(m["e"] - F.greatest(m["s"], a["e"]), F.lit(0).cast("bigint"))).alias("n"),
        F.greatest(a["e"], m["e"]).alias("e")))
    ids = F.array_sort(F.array_distinct(F.transform(exact, lambda m: m["item_id"].cast("string"))))
    return (found.withColumn("_hit", hit).withColumn("_ids", ids)
            .select("doc_id", "n_words", F.col("_hit.n").alias("n_hit"), F.size("_ids").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("_ids", ","), 256).alias("items_sha256"), (F.col("_hit.n") > 0).alias("contaminated")))
