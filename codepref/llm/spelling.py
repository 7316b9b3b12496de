"""Spelling variants: words that differ in one code point, found by a trie frontier.

The vocabulary is held as two tries, of the words and of the words reversed, in one
distributed edge table (node, label, child): nodes are prefixes that end a word or
where words part, labels the code points between. States (word, position, node) start
with no edit at the nodes on a word's own path; one edit, a code point skipped or
another edge taken, makes them one-edit states, which are joined with the edge table
level by level until their words are used up. States that then stand on a word's end
are neighbours.

An edit in the second half of a word is found in the first trie, one in the first half
in the second trie, so no state walks the crowded edges near a root. Of two words of
one length the one with the smaller code point looks for the other; of others the longer
one for the shorter. Words that share a run of equal code points skip its last one.

Prefixes are known by 64-bit hashes; two prefixes with one hash only add states, as each
pair found is compared once more.

Defined cases: null texts have no words, a null doc_id is the empty text in the hash of a
run; copies and repeated rows count as often as they stand; ties of the count go to the
word that is smaller by code points; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codepref.llm.common import materialize

#: A word has so many code points and occurrences at least.
LENGTH, COUNT = 7, 2
#: A form occurs so many times as often as the word.
RATIO = 10
# The letters of a run after A-Z are lower-cased, and the noise.
LETTERS = r"a-zÀ-ÿ"
NOISE = 31

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, noise: int | None = NOISE) -> DataFrame:
    """(word, n): the distinct words and their occurrences. With ``noise``, one code
    point is deleted from the runs whose crc32 with the doc_id it divides."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]{{{LENGTH},}})"), 1)).alias("run"))
    if noise:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        runs = runs.select("run", h.alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("run"))
    return (runs.where(F.length("run") >= LENGTH).groupBy(F.col("run").alias("word"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COUNT))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each word's prefixes of (length - 2) / 2 code points and more."""
    for batch in batches:
        texts = batch["w"].to_pylist()
        if not texts:
            continue
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size) - size
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        place = np.arange(len(code)) - np.repeat(start, size)
        power = np.multiply.accumulate(np.full(int(size.max()), 0xD6E8FEB86659FD93, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(code) * power[place])])
        first = np.maximum(0, (size - 1) // 2)  # ceil((length - 2) / 2)
        n = size - first + 1
        word = np.repeat(np.arange(len(texts)), n)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + first[word]
        side = np.asarray(batch["side"]).astype(np.uint64)[word]
        node = _mix((total[start[word] + depth] - total[start[word]]) ^ _mix(depth.astype(np.uint64) * np.uint64(2) + side))
        nodes = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), node.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch["side"], batch["w"], pa.array(first.astype(np.int32)), nodes],
                                         ["side", "w", "first", "nodes"])


def trie(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tries of the (word) table: ends (node, side, w), edges (node, label, child), and
    the nodes on each word's path, stops (side, w, array of (d, node))."""
    both = vocabulary.select(F.lit(0).alias("side"), F.col("word").alias("w")).unionByName(
        vocabulary.select(F.lit(1).alias("side"), F.reverse("word").alias("w")))
    paths = materialize(both.mapInArrow(_paths, "side int, w string, first int, nodes array<bigint>"))
    ends = paths.select(F.element_at("nodes", -1).alias("node"), "side", "w")
    steps = paths.select("side", "w", "first", F.posexplode("nodes").alias("i", "node")).select(
        "side", "w", (F.col("first") + F.col("i")).alias("d"), "node")
    after = F.substring("w", F.col("d") + 1, F.lit(1))
    # the empty text stands for the end, so words part where one ends as well
    kinds = steps.groupBy("node").agg(F.min(after).alias("least"), F.max(after).alias("most"))
    nodes = kinds.where("least <> most or least = ''").select("node")
    stops = steps.join(nodes, "node").groupBy("side", "w").agg(F.sort_array(F.collect_list(F.struct("d", "node"))).alias("stops"))
    stops = materialize(stops)
    pair = F.arrays_zip(F.slice("stops", 1, F.size("stops") - 1).alias("a"), F.slice("stops", 2, F.size("stops") - 1).alias("b"))
    e = stops.where(F.size("stops") > 1).select("w", F.explode(pair).alias("e"))
    label = F.substring("w", F.col("e.a.d") + 1, F.col("e.b.d") - F.col("e.a.d"))
    edges = materialize(e.select(F.col("e.a.node").alias("node"), label.alias("label"), F.col("e.b.node").alias("child")).distinct())
    return ends, edges, stops


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, near), both ways, of the (word) table's words that differ in one code point."""
    ends, edges, stops = trie(vocabulary)
    size, width = F.length("w"), F.length("label")
    fresh = stops.select("side", "w", F.explode("stops").alias("s")).select("side", "w", F.col("s.d").alias("pos"), "s.node")
    fresh = fresh.where((F.col("pos") < size) & (F.col("pos") * 2 + 1 >= size))
    skipped = fresh.select("side", "w", (F.col("pos") + 1).alias("pos"), "node")
    here = F.substring("w", F.col("pos") + 1, F.lit(1))
    rest = F.substring("w", F.col("pos") + 2, width - 1) == F.substring("label", F.lit(2), width)
    moved = ["side", "w", (F.col("pos") + width).alias("pos"), F.col("child").alias("node")]
    swapped = fresh.join(edges, "node").where((here < F.substring("label", F.lit(1), F.lit(1))) & rest).select(*moved)
    states, found = materialize(skipped.unionByName(swapped)), []
    while True:
        over = F.col("pos") >= size
        found.append(states.where(over).select("side", "w", "node"))
        going = states.where(~over).withColumn("next", here)
        onward = going.join(edges.withColumn("next", F.substring("label", F.lit(1), F.lit(1))), ["node", "next"])
        states = materialize(onward.where(F.substring("w", F.col("pos") + 1, width) == F.col("label")).select(*moved))
        if states.isEmpty():
            break
    done = found[0]
    for f in found[1:]:
        done = done.unionByName(f)
    met = done.join(ends.select("node", F.col("side").alias("side2"), F.col("w").alias("v")), "node").where("side = side2")
    back = [F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("w", "v")]
    pairs = met.select(*back).where(F.levenshtein("w", "v", 1) == 1)
    return materialize(pairs.select(F.col("w").alias("word"), F.col("v").alias("near")).unionByName(
        pairs.select(F.col("v").alias("word"), F.col("w").alias("near"))).distinct())


def group(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a (word, n) table of distinct words: form is
    the most frequent neighbour, if it occurs ``ratio`` times as often."""
    vocabulary = materialize(vocabulary.select("word", "n"))
    near = neighbours(vocabulary.select("word"))
    told = near.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best")
    per = told.groupBy("word").agg(best, F.count(F.lit(1)).alias("n_near"))
    rows = vocabulary.join(per, "word", "left")
    strong = -F.col("best.less") >= F.col("n") * ratio
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                   F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    # counts grow along forms, so they make no circle; each round doubles the steps taken
    at = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("far")), "root", "left")
        at = materialize(on.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return rows.join(at.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
