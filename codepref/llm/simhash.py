"""SimHash near-duplicates by multi-index hashing.

A fingerprint is 64 majority bits over the hashes of a text's word shingles.
Pairs of different fingerprints within ``radius`` bits are found without
comparing all: the 64 bits are cut into segments, each fingerprint is filed
under each segment's value, and looks up every value in a small Hamming ball
around its own. By the pigeonhole rule of multi-index hashing (Norouzi et al.,
2012) two fingerprints within ``radius`` bits meet in such a lookup; the whole
distance is then checked.

Defined cases: a null or wordless text has fingerprint zero, linked like any
other; a text of fewer words than a shingle is one shingle; repeated rows share
their fingerprint, so they are in one component. Null ids are kept; the smallest
id of a component ignores them, and is null if there is no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepref.llm.common import components, materialize

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case. ``bytes.split`` cuts
    at exactly the contract's bytes (x20, x09-x0D)."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    w = words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], dtype=np.uint64)
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1)
    starts = np.r_[0, ends[:-1]]
    spans = zip(starts[:len(w) - k + 1].tolist(), (ends[k - 1:] - 1).tolist())
    return np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory on very long texts
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(shingle_hashes(t, shingle)) for t in texts], dtype="int64")

    return prints(text)


def segments(radius: int, parts: int) -> list[tuple[int, int, int]]:
    """(low bit, width, ball radius) of each segment that is looked up. With
    radius = parts * q + a, the first a + 1 segments need a ball of q, the others
    one of q - 1 (none at all if that is negative)."""
    q, a = divmod(radius, parts)
    edges = [64 * i // parts for i in range(parts + 1)]
    balls = [q if i <= a else q - 1 for i in range(parts)]
    return [(lo, hi - lo, r) for lo, hi, r in zip(edges, edges[1:], balls) if r >= 0]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def ball(width: int, radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(range(width), r)]


def links(prints: DataFrame, radius: int = 2, parts: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of column ``fp`` within
    ``radius`` bits, each once."""
    segs = segments(radius, parts)

    def key(fp: str, lo: int, width: int) -> Column:
        return F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit(_signed((1 << width) - 1)))

    filed = prints.select(F.col("fp").alias("b"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"), key("fp", lo, w).alias("key")) for i, (lo, w, _) in enumerate(segs)
    ])).alias("at")).select("at.seg", "at.key", "b")

    def around(lo: int, width: int, r: int) -> Column:
        masks = F.array(*[F.lit(m).cast("bigint") for m in ball(width, r)])
        return F.transform(masks, lambda m: key("fp", lo, width).bitwiseXOR(m))

    asked = prints.select(F.col("fp").alias("a"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"), around(lo, w, r).alias("keys")) for i, (lo, w, r) in enumerate(segs)])).alias("at")
    ).select("a", "at.seg", F.explode("at.keys").alias("key"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    near = (asked.join(filed, ["seg", "key"])
            .where((F.col("a") < F.col("b")) & (F.bit_count(diff) <= radius)).withColumn("_diff", diff))
    # a pair met in several segments is kept in the first one that finds it
    earlier = F.lit(False)
    for i, (lo, w, r) in enumerate(segs):
        hit = F.bit_count(F.shiftrightunsigned(F.col("_diff"), lo).bitwiseAND(F.lit(_signed((1 << w) - 1)))) <= r
        earlier = earlier | ((F.col("seg") > i) & hit)
    return near.where(~earlier).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, parts: int = 2, row: str | None = None) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the
    smallest doc_id reachable over links of at most ``radius`` bits. With ``row``,
    a column that numbers the rows, also that column and ``root``, the component's
    smallest fingerprint."""
    more = [F.col(row)] if row else []
    prints = materialize(docs.select("doc_id", *more, fingerprint(F.col("text"), shingle).alias("fp")))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    member = components(links(distinct.select("fp"), radius, parts)).withColumnRenamed("node", "fp")
    grouped = distinct.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = materialize(grouped.join(least, "root").select("fp", "component_id", "root"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id", *([*more, "root"] if row else []))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
