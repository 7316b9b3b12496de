"""Sharding by extendible hashing, in DataFrame operations only.

A document's bucket is a prefix of its hash bits. Only a bucket over the byte
limit splits on another bit, until every shard fits. The directory is worked out
from byte counts: counts per fine cell (a few bits more than the average depth
needs) are summed for every shorter prefix of the cell, and a cell's shard is the
shortest prefix that fits. Documents of a cell that is itself too large get the
same treatment with all their bits. Rows whose bits are used up (one key over the
limit) go to overflow pages of at most the limit.

Defined cases: a null text has 0 bytes; a null id hashes as the empty text; a
single document over the limit is alone in its shard or page, marked oversize;
a key over the limit fills at most about twice the pages that its bytes need, its
repeated rows in turn; an empty table gives no rows; extra columns that have the name of an added one get a
trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepref.llm.common import HASH_BITS, hash60, make_way, materialize, one_of, running_total

LIMIT = 1 << 20
#: Bits of a fine cell beyond those of the average shard.
EXTRA_BITS = 3


def _leaves(cells: DataFrame, bits: int, first: int, limit: int) -> DataFrame:
    """cells (cell of ``bits`` bits, bytes, n) with depth: the shortest prefix
    from ``first`` bits on whose bytes fit; null where none does."""
    up = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(bits))))
    up = up.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    fits = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    best = up.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.join(best, "cell", "left").select("cell", "bytes", "n", "depth")


def directory(keys: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None, int]:
    """From (h, bytes) rows: the directory by cell, the directory by single hash
    for the cells that are too large (None if there are none), bits of a cell."""
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(HASH_BITS, max(1, total // limit).bit_length() + EXTRA_BITS)

    def counted(rows: DataFrame, cell: Column) -> DataFrame:
        return rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))

    cell = F.shiftright("h", HASH_BITS - bits)
    cells = materialize(_leaves(counted(keys, cell), bits, 0, limit))
    large = cells.where("depth is null").select("cell")
    if large.isEmpty():
        return cells, None, bits
    inside = keys.withColumn("cell", cell).join(large, "cell")
    return cells, materialize(_leaves(counted(inside, F.col("h")), HASH_BITS, bits, limit)), bits


def shard(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", seed: str = ":shard") -> DataFrame:
    """``docs`` with columns shard (its hash bits), shard_depth (how many),
    shard_page (0; overflow pages from 1) and oversize. Each (shard, page) holds
    at most ``limit`` text bytes unless it is a single oversize document."""
    docs = make_way(docs, ("shard", "shard_depth", "shard_page", "oversize"))
    cols = docs.columns
    h, size, cell, depth, n, deep = (one_of(cols, c) for c in ("_h", "_bytes", "_cell", "_depth", "_n", "_deep"))
    own = [F.col(f"`{c}`") for c in cols]
    keyed = docs.withColumn(h, hash60(F.col(f"`{key}`"), seed)).withColumn(
        size, F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("bigint"))
    cells, exact, bits = directory(keyed.select(F.col(h).alias("h"), F.col(size).alias("bytes")), limit)
    placed = keyed.withColumn(cell, F.shiftright(F.col(h), HASH_BITS - bits)).join(
        cells.select(F.col("cell").alias(cell), F.col("depth").alias(depth)), cell)
    if exact is not None:
        # the hash stands in for the whole key where all its bits are used up
        fine = exact.select(F.col("cell").alias(h), F.col("depth").alias(deep), F.col("n").alias(n))
        placed = placed.join(fine, h, "left").withColumn(depth, F.coalesce(depth, deep))
    else:
        placed = placed.withColumn(n, F.lit(1))
    full = F.lpad(F.conv(F.col(h).cast("string"), 10, 2), HASH_BITS, "0")

    def named(df: DataFrame, suffix: Column, page: Column, over: Column) -> DataFrame:
        at = F.coalesce(F.col(depth), F.lit(HASH_BITS))
        return df.select(*own, F.concat(F.lit("b"), F.left(full, at.cast("int")), suffix).alias("shard"),
                         at.cast("int").alias("shard_depth"), page.cast("bigint").alias("shard_page"), over.alias("oversize"))

    paged = F.col(depth).isNull() & (F.col(n) > 1)
    out = named(placed.where(~paged), F.lit(""), F.lit(0), F.col(depth).isNull())
    if exact is None or exact.where("depth is null and n > 1").isEmpty():
        return out
    # one key over the limit: its rows of up to half the limit are laid one after another
    # in the order of their digests and cut at every half, so a page that the last of
    # them overhangs is within the limit; larger ones get a page each. Only digests and
    # sizes are laid out; equal rows are counted (map-side) and take places in turn
    at, a, b, n_equal, first = (one_of(cols, c) for c in ("_at", "_a", "_b", "_equal", "_first"))
    half = max(1, limit // 2)
    known = placed.where(paged).withColumns({a: F.xxhash64(*own), b: F.xxhash64(F.lit(1), *own)})
    kinds = known.groupBy(F.col(h).alias("h"), F.col(size).alias("bytes"), F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("room", F.col("n") * F.when(F.col("bytes") <= half, F.col("bytes")).otherwise(1))
    kinds = materialize(kinds)
    small, large = kinds.where(F.col("bytes") <= half), kinds.where(F.col("bytes") > half)
    pages = small.groupBy("h").agg((F.floor(F.sum("room") / half) + 1).alias("before"))
    laid = running_total(small, ["h"], ["a", "b"], "room", "upto").withColumn("before", F.lit(0))
    single = running_total(large, ["h"], ["a", "b"], "room", "upto").join(pages, "h", "left").withColumn(
        "before", F.coalesce("before", F.lit(0)))
    starts = laid.unionByName(single).select(F.col("h").alias(h), F.col("a").alias(a), F.col("b").alias(b),
                                             (F.col("upto") - F.col("room")).alias(first), F.col("before").alias(n))
    equal = known.drop(n).groupBy(*own, h, size, depth, a, b).agg(F.count(F.lit(1)).alias(n_equal))
    rows = equal.join(starts, [h, a, b]).withColumn(at, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n_equal) - 1)))
    page = F.when(F.col(size) <= half, F.floor((F.col(first) + F.col(at) * F.col(size)) / half)).otherwise(F.col(n) + F.col(first) + F.col(at))
    return out.unionByName(named(rows, F.lit(""), page + 1, F.col(size) > limit))
