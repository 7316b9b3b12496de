"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

Each line is the set of its words. Words are ordered by rarity over all lines;
two sets with Jaccard similarity of at least ``SIMILARITY`` must share a word
among the first few of each in that order (prefix filter). Such pairs are tested
by length, by the places of the shared word (positional filter) and by a bound
on their symmetric difference from 128 parities, and what is left is verified
on the whole sets (PPJoin, Xiao et al., 2008).

Equal sets are one class, so copies make no pairs; a class stands at its first
line in (doc_id, line) order. Whole sets are only fetched where needed: a set's
distance to its hub (the candidate with most candidates) is measured, and as
Jaccard distance is a metric, two sets whose distances to a common hub add up to
little enough are linked without being compared. The other pairs are compared word by word.

Large groups of near copies are told apart first, so that their pairs are counted and
not written: a group's centre is the set of the words that most of its sets have, and a
set is known by the words that it lacks of the centre or has beside it. Two sets a and b
of sizes m and n differ in d(a) + d(b) - 2c words, d being the numbers of those words and
c how many are common to both. They are similar if that is at most (m + n) / 9 (for 4/5),
so s(a) + s(b) <= 18c with s(x) = 9 d(x) - size(x): for s(a) + s(b) <= 0 in any case, which
is counted by a running total over s; other pairs must share such a word and are joined by
it. The filters above then look for pairs of different groups only. Which sets are
grouped changes no result.

A line is removed if its set, or a similar one, stands at an earlier line.

Rarity: words are counted in 65,536 hash buckets over all lines; the order is by
the bucket's rank, then by the rest of the word's 64-bit hash. Any one order
gives the same pairs; the ranks only keep common words out of the prefixes. The
ranks are one table of fixed size through the driver, the bits that tell which
lines are read again another.

Defined cases: null texts have no lines; lines without words are kept and never
matched; words are cut at ASCII white space and compared by their 64-bit hash;
each row is decided by its own text: a row is known by its doc_id and its text's
digest, in this order, so only repeated rows are one, stand at the same places and
don't remove each other; a null doc_id stands before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codepref.llm.common import materialize, one_of

#: The least similarity, as a fraction.
SIMILARITY = (4, 5)
RANK_BITS = 16
MEMBER_BITS = 22
#: Tables of at most so many (short) rows are broadcast; larger ones are joined.
BROADCAST_ROWS = 500_000
#: Sets that make a group of near copies.
GROUP_SETS = 8
GAPS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
PLACE = ("doc_id", "text_id", "line_no")


def _ceil(x: Column, p: int, q: int) -> Column:
    return F.floor((x * p + (q - 1)) / q)


def _pieces(line: Column) -> Column:
    """A line cut at white space, at times with empty pieces; the common case, only
    spaces, needs no pattern."""
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.split(line, GAPS)).otherwise(F.split(line, " "))


def _words(line: Column) -> Column:
    """Words of a line; most lines have no empty pieces to drop."""
    tight = F.btrim(line, F.lit(SPACES)) == line
    for c in ("  ", "\t", "\x0b", "\x0c", "\r"):
        tight = tight & ~F.contains(line, F.lit(c))
    return F.when(tight & (line != ""), F.split(line, " ")).otherwise(F.array_remove(_pieces(line), ""))


def _literal(values: list[int]) -> Column:
    """A constant array (folded when the plan is made)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _checked(table: DataFrame) -> DataFrame:
    """A written table, broadcast if its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def word_sets(docs: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(doc_id, text_id, line_no, h): the distinct word hashes of each line that has
    words, or only of those lines whose place is ``wanted``. Blank lines are told by
    the line itself: a test of h would be pushed down and hash each line twice."""
    text = F.col("text").cast("string")
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_id"), F.split(text, "\n").alias("lines"))
    lines = texts.select("doc_id", "text_id", F.posexplode("lines").alias("line_no", "line"))
    lines = lines.where(F.btrim("line", F.lit(SPACES)) != "")
    if wanted is not None:
        lines = lines.where(wanted)
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    return lines.select(*PLACE, hashes.alias("h"))


def rarity_key(docs: DataFrame):
    """A one-to-one map of word hashes to integers whose order is by rarity."""
    flat = docs.select(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(" ")).alias("text"))
    words = flat.select(F.explode(_pieces(F.col("text"))).alias("w")).where("w <> ''")
    bucket = F.shiftrightunsigned(F.xxhash64("w"), 64 - RANK_BITS)
    counted = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["b"]: r["n"] for r in counted.collect()}  # at most 2 ** RANK_BITS rows
    # a hash's first bits are its bucket; what turns them into the bucket's rank is told.
    # Ranks start below zero so that signed order is the order of ranks
    shift, turn = 64 - RANK_BITS, [0] * (1 << RANK_BITS)
    for i, b in enumerate(sorted(range(1 << RANK_BITS), key=lambda b: (counts.get(b, 0), b))):
        change = (i ^ b ^ (1 << (RANK_BITS - 1))) << shift
        turn[b] = change - (1 << 64) if change >> 63 else change
    turns = _literal(turn)

    def key(h: Column) -> Column:
        # never null, and told so: arrays of such keys are sorted as plain longs
        return h.bitwiseXOR(F.coalesce(F.get(turns, F.shiftrightunsigned(h, shift).cast("int")), F.lit(0).cast("bigint")))

    return key


def _parities(k: str) -> list[Column]:
    """128 bits, each the parity of the words that fall on it: sets that differ in d
    words differ in at most d bits."""
    def odd(one):
        return F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(
            F.call_function("shiftleft", one(x), x.bitwiseAND(F.lit(63)).cast("int"))))

    every = odd(lambda x: F.lit(1).cast("bigint"))
    half = odd(lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1).cast("bigint")))
    return [half.alias("p0"), every.bitwiseXOR(half).alias("p1")]


def _digest(k: str = "k") -> list[Column]:
    return [F.xxhash64(k).alias("sa"), F.xxhash64(F.lit(1), F.col(k)).alias("sb")]


def keyed_lines(docs: DataFrame, key, similarity: tuple[int, int]) -> DataFrame:
    """One written row per line with words: id, place, digest of the set, size,
    parities, and the prefix in order of rarity."""
    keyed = word_sets(docs).select(*PLACE, F.sort_array(F.transform("h", key)).alias("k"))
    n = F.size("k")
    prefix = F.slice("k", F.lit(1), (n - _ceil(n, *similarity) + 1).cast("int"))
    return materialize(keyed.select(
        F.monotonically_increasing_id().alias("lid"), *PLACE, *_digest(), n.cast("bigint").alias("n"),
        *_parities("k"), prefix.alias("prefix")), "snappy")  # hashes don't shrink


def copies(lines: DataFrame) -> DataFrame:
    """(sa, sb, cid, n_lines) of the sets that several lines have; cid is the first line's id."""
    first = F.min(F.struct(*PLACE, "lid"))
    found = lines.groupBy("sa", "sb").agg(first.alias("at"), F.count(F.lit(1)).alias("n_lines")).where("n_lines > 1")
    return materialize(found.select("sa", "sb", F.col("at.lid").alias("cid"), "n_lines"))


def _classed(lines: DataFrame, several: DataFrame) -> DataFrame:
    """Lines with the id of their class and whether they are its first line."""
    out = lines.join(_checked(several.select("sa", "sb", "cid")), ["sa", "sb"], "left")
    return out.withColumn("cid", F.coalesce("cid", "lid"))


def _member(wanted: DataFrame, *cols: str) -> Column:
    """Whether a row's columns may be among the wanted ones': a bit for their hash
    in a table of fixed size."""
    size = 1 << MEMBER_BITS
    at = F.xxhash64(*cols).bitwiseAND(F.lit(size - 1))
    held = wanted.select(at.alias("bit")).distinct().groupBy(F.shiftright("bit", 5).alias("w")).agg(
        F.sum(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("v"))
    words = [0] * (size >> 5)
    for r in held.collect():  # at most 2 ** MEMBER_BITS / 32 rows
        words[r["w"]] = r["v"]
    word = F.get(_literal(words), F.shiftright(at, 5).cast("int"))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(31)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def words_at(docs: DataFrame, key, wanted: DataFrame) -> DataFrame:
    """(lid, k) of the wanted (lid, doc_id, text_id, line_no, sa, sb): texts that may hold
    one are read again, and only the lines that may be one go further."""
    some = docs.where(_member(wanted, "doc_id"))
    near = word_sets(some, _member(wanted, *PLACE)).select(*PLACE, F.sort_array(F.transform("h", key)).alias("k"))
    near = near.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t"), F.col("line_no").alias("_l"), "k", *_digest())
    same = wanted["doc_id"].eqNullSafe(F.col("_d"))
    for w, x in (("text_id", "_t"), ("line_no", "_l"), ("sa", "sa"), ("sb", "sb")):
        same = same & (wanted[w] == near[x])
    found = near.join(wanted.select("lid", *PLACE, "sa", "sb"), same)
    return materialize(found.select("lid", "k").dropDuplicates(["lid"]))


def _compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs (a, b) with shared and either: the sizes of the sets' intersection and union."""
    x, y = words.select(F.col("lid").alias("a"), F.col("k").alias("ka")), words.select(F.col("lid").alias("b"), F.col("k").alias("kb"))
    shared = F.size(F.array_intersect("ka", "kb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("shared", shared)
    return both.select("a", "b", "shared", (F.size("ka") + F.size("kb") - F.col("shared")).alias("either"))


def verified(pairs: DataFrame, words: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The candidate pairs (a, b) whose sets are at least that similar."""
    p, q = similarity
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a set's hub is the one with most candidates among it and its candidates
    degree = materialize(ends.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select(
        "a", F.struct("n", (-F.col("a")).alias("at")).alias("rank")))
    hub = (ends.join(degree.select(F.col("a").alias("b"), "rank"), "b").groupBy("a").agg(F.max("rank").alias("top"))
           .join(degree, "a").where("top > rank"))
    first = hub.select("a", (-F.col("top.at")).alias("b"))
    # distances in units of 2 ** -24, rounded up: sums of two never look too small
    unit = 1 << 24
    apart = F.ceil(F.lit(float(unit)) * (F.col("either") - F.col("shared")) / F.col("either")).cast("bigint")
    near = materialize(_compared(first, words).select(F.col("a").alias("lid"), F.col("b").alias("lead"), apart.alias("d"),
                                                      (F.col("shared") * q >= F.col("either") * p).alias("ok")))
    placed = pairs
    for s in "ab":
        side = near.select(F.col("lid").alias(s), *[F.col(c).alias(c + s) for c in ("lead", "d", "ok")])
        placed = placed.join(side, s, "left").withColumns(
            {"lead" + s: F.coalesce("lead" + s, s), "d" + s: F.coalesce("d" + s, F.lit(0))})
    close = (F.col("leada") == F.col("leadb")) & (F.col("da") + F.col("db") <= unit * (q - p) // q)
    # null: not known yet
    known = F.when(F.col("leada") == F.col("b"), F.col("oka")).when(F.col("leadb") == F.col("a"), F.col("okb")).when(close, True)
    placed = materialize(placed.select("a", "b", known.alias("linked")))
    rest = _compared(placed.where("linked is null").select("a", "b"), words).where(F.col("shared") * q >= F.col("either") * p)
    return placed.where("linked").select("a", "b").unionByName(rest.select("a", "b"))


def near_groups(firsts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(lid, place, digest, hub, sets) of the sets in groups of near copies; hub is a group's
    least lid, sets its size. Each word's leader is the set with the least parities among those that have it in their
    prefix; sets near a leader are its group. As near copies have several such leaders, each set
    then joins the largest group whose usual words are half its prefix."""
    p, q = similarity
    parities = F.col("p0").bitwiseXOR(F.col("p1")).alias("e")
    sets = firsts.select("lid", parities, "n", F.size("prefix").alias("words"), F.explode("prefix").alias("key"))
    leads = materialize(sets.groupBy("key").agg(F.min("e").alias("lead"), F.count(F.lit(1)).alias("sets"))
                        .where(F.col("sets") >= GROUP_SETS).select("key", "lead"))
    # half as far again as similar sets: the leader may stand at the group's edge
    near = F.bit_count(F.col("e").bitwiseXOR(F.col("lead"))) * (p + q) <= F.col("n") * (3 * (q - p))
    led = materialize(sets.join(_checked(leads), "key").where(near).groupBy("lid").agg(F.min("lead").alias("lead")))
    large = led.groupBy("lead").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") >= GROUP_SETS)
    held = firsts.select("lid", "prefix").join(_checked(led), "lid").join(large, "lead").select("lead", "sets", F.explode("prefix").alias("key"))
    usual = held.groupBy("lead", "sets", "key").agg(F.count(F.lit(1)).alias("n"))
    usual = materialize(usual.where(F.col("n") * 2 > F.col("sets")).drop("n"))
    votes = sets.select("lid", "words", "key").join(_checked(usual), "key").groupBy("lid", "words", "lead", "sets").agg(F.count(F.lit(1)).alias("n"))
    led = votes.where(F.col("n") * 2 >= F.col("words")).groupBy("lid").agg(F.max(F.struct("sets", "lead")).alias("top"))
    led = materialize(led.select("lid", F.col("top.lead").alias("lead")))
    large = led.groupBy("lead").agg(F.min("lid").alias("hub"), F.count(F.lit(1)).alias("sets")).where(F.col("sets") >= GROUP_SETS)
    found = led.join(large, "lead").drop("lead")
    return materialize(firsts.select("lid", *PLACE, "sa", "sb").join(found, "lid"))


def centred(members: DataFrame, words: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(lid, place, hub, s, diff): how each set of a group differs from the group's centre."""
    p, q = similarity
    told = members.select("lid", *PLACE, "hub", "sets").join(words, "lid")
    common = told.select("hub", "sets", F.explode("k").alias("w")).groupBy("hub", "sets", "w").agg(F.count(F.lit(1)).alias("n"))
    centre = common.where(F.col("n") * 2 > F.col("sets")).groupBy("hub").agg(F.collect_list("w").alias("centre"))
    told = told.join(centre, "hub", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    told = told.withColumn("diff", F.concat(F.array_except("k", "centre"), F.array_except("centre", "k")))
    s = (F.size("diff") * (p + q) - F.size("k") * (q - p)).cast("bigint")
    return materialize(told.select("lid", *PLACE, "hub", s.alias("s"), "diff"))


def counted_links(members: DataFrame) -> DataFrame:
    """(lid, there, n_links) of the links that follow from s alone: how many, and the
    first place among the linked sets and the set itself."""
    levels = members.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("there"))
    asked = levels.select("hub", (-F.col("s")).alias("at"), F.lit(True).alias("ask"), F.lit(0).cast("bigint").alias("n"),
                          F.lit(None).cast(levels.schema["there"].dataType).alias("there"), "s")
    points = levels.select("hub", F.col("s").alias("at"), F.lit(False).alias("ask"), "n", "there", "s").unionByName(asked)
    upto = Window.partitionBy("hub").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    found = points.select("hub", "s", "ask", F.sum("n").over(upto).alias("n"), F.min("there").over(upto).alias("there")).where("ask")
    out = members.select("lid", "hub", "s").join(found.drop("ask"), ["hub", "s"])
    return out.select("lid", "there", (F.col("n") - (F.col("s") <= 0).cast("bigint")).alias("n_links"))


def inner_links(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The links (a, b) within groups that do not follow from s alone, each made once, at
    the first word that both differences have."""
    p, q = similarity
    rows = members.select("hub", "lid", "s", "diff", F.explode("diff").alias("w"))
    a, b = rows.alias("a"), rows.alias("b")
    far, shared = F.col("a.s") + F.col("b.s"), F.array_intersect("a.diff", "b.diff")
    pairs = a.join(b, (F.col("a.hub") == F.col("b.hub")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.lid") < F.col("b.lid"))
                   & (far > 0) & (far <= F.least(F.size("a.diff"), F.size("b.diff")) * (2 * (p + q)))
                   & (far <= F.size(shared) * (2 * (p + q))) & (F.get(shared, F.lit(0)) == F.col("a.w")))
    return pairs.select(F.col("a.lid").alias("a"), F.col("b.lid").alias("b"))


def candidates(firsts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b), n(a) >= n(b), of different groups (``hub``, if any) that pass
    all filters. Both sides are one shuffle of the same rows."""
    p, q = similarity
    hub = F.col("hub") if "hub" in firsts.columns else F.col("lid")
    rows = firsts.select("lid", hub.alias("hub"), "p0", "p1", F.posexplode("prefix").alias("pos", "key"), "n").select(
        "key", "lid", "hub", "p0", "p1", (F.shiftleft("n", 32) + F.col("n") - F.col("pos")).alias("sizes"))
    a, b = rows.alias("a"), rows.alias("b")
    na, nb = F.shiftright("a.sizes", 32), F.shiftright("b.sizes", 32)
    ra, rb = (F.col(f"{s}.sizes").bitwiseAND(F.lit((1 << 32) - 1)) for s in "ab")
    need = _ceil(na + nb, p, p + q)
    # of the shorter set a shorter prefix is enough (the second half of the "or" is
    # never true; it keeps the test out of one side's scan, so the shuffle is shared)
    answers = (nb - rb < nb - _ceil(nb * 2, p, p + q) + 1) | (na < nb)
    apart = F.bit_count(F.col("a.p0").bitwiseXOR(F.col("b.p0"))) + F.bit_count(F.col("a.p1").bitwiseXOR(F.col("b.p1")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (na >= nb) & (nb * q >= na * p) & answers
                   & ((na > nb) | (F.col("a.lid") < F.col("b.lid"))) & (F.col("a.hub") != F.col("b.hub"))
                   & (F.least(ra, rb) >= need)
                   & (apart <= na + nb - need * 2))
    return materialize(pairs.select(F.col("a.lid").alias("a"), F.col("b.lid").alias("b")).distinct())


def class_links(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY):
    """The lines, the sets that several lines have, the links (a, b) of classes that are
    not counted, those that are (``counted_links``), and the places of all that may be linked."""
    key = rarity_key(docs)
    lines = keyed_lines(docs, key, similarity)
    several = copies(lines)
    firsts = _classed(lines, several).where("cid = lid")
    members = near_groups(firsts, similarity)
    grouped = firsts.join(_checked(members.select("lid", "hub")), "lid", "left").withColumn("hub", F.coalesce("hub", "lid"))
    pairs = candidates(grouped, similarity)
    named = pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).union(members.select("lid")).distinct()
    places = materialize(firsts.select("lid", *PLACE, "sa", "sb").join(named, "lid"))
    words = words_at(docs, key, places)
    members = centred(members, words, similarity)
    links = verified(pairs, words, similarity).unionByName(inner_links(members, similarity))
    return lines, several, materialize(links), counted_links(members), places


def duplicate_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, text_id, line_no, class_id, removed, n_links) of the lines that match another:
    removed where an equal or similar set stands earlier; n_links: other classes
    that are similar."""
    lines, several, links, counted, places = class_links(docs, similarity)
    at = F.struct(*PLACE)
    ends = links.select(F.col("a").alias("lid"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("lid"), F.col("a").alias("other")))
    there = _checked(places.select(F.col("lid").alias("other"), at.alias("there")))
    per = ends.join(there, "other").groupBy("lid").agg(F.min("there").alias("there"), F.count(F.lit(1)).alias("n_links"))
    per = per.unionByName(counted.where("n_links > 0")).groupBy("lid").agg(F.min("there").alias("there"), F.sum("n_links").alias("n_links"))
    # only linked sets and those of several lines match another line
    told = materialize(per.join(several.select(F.col("cid").alias("lid")), "lid", "full").select(
        "lid", "there", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    told = materialize(lines.select("lid", at.alias("at")).join(_checked(told), "lid").select(
        F.col("lid").alias("cid"), "at", F.coalesce(F.col("there") < F.col("at"), F.lit(False)).alias("late"), "n_links"))
    hit = _classed(lines.select("lid", *PLACE, "sa", "sb"), several).join(_checked(told), "cid")
    earlier = F.col("late") | (F.col("at") < at)
    return hit.select(*PLACE, F.col("cid").alias("class_id"), earlier.alias("removed"), "n_links").distinct()


def _per_row(docs: DataFrame, text_id: Column, hits: DataFrame, *sums: Column) -> DataFrame:
    """``docs`` with what ``hits`` add up to for the row's id and text, of which ``text_id``
    is the digest (null without any)."""
    doc, text = one_of(docs.columns, "_doc"), one_of(docs.columns, "_text_id")
    per = hits.groupBy(F.col("doc_id").alias(doc), F.col("text_id").alias(text)).agg(*sums)
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & (text_id == F.col(text))
    return docs.join(per, same, "left").drop(doc, text)


def summary(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: n_lines, removed_lines (numbers from 0), n_removed and
    n_links (of its lines, to other classes)."""
    docs, text = docs.select("doc_id", "text"), F.col("text").cast("string")
    n = F.coalesce(F.size(F.split(text, "\n")), F.lit(0))
    # the texts themselves stay out of the join
    told = docs.select("doc_id", F.xxhash64(text).alias("text_id"), F.when(n < 0, 0).otherwise(n).cast("bigint").alias("n_lines"))
    rows = _per_row(told, told["text_id"], duplicate_lines(docs, similarity),
                    F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line_no")))).alias("removed_lines"), F.sum("n_links").alias("n_links"))
    kept = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", kept.alias("removed_lines"), F.size(kept).cast("bigint").alias("n_removed"),
                       F.coalesce("n_links", F.lit(0)).alias("n_links"))


def dedup(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with the removed lines cut from text."""
    cut = one_of(docs.columns, "_cut")
    rows = _per_row(docs, F.xxhash64(docs["text"].cast("string")), duplicate_lines(docs, similarity).where("removed"), F.collect_set("line_no").alias(cut))
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    stay = F.filter(lines, lambda x: ~F.array_contains(cut, x["i"]))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda x: x["x"]), "\n"))
    return rows.withColumn("text", text).drop(cut)
