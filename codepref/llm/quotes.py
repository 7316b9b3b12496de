"""Quotation linking, in DataFrame operations only.

A message's lines are parsed into quote levels (leading ">" marks). Its paragraphs
(lines of one level between blank lines) are normalised and hashed; quoted ones
are joined, within their thread, to the message that first wrote a paragraph with
the same hash at level 0. A quoted paragraph that is found nowhere is linked by its
lines and sentences (of at least ``MIN_UNIT`` characters, normalised) to the message
that first wrote most of them, so a quote of a part of a paragraph, or one that
answers cut into pieces, is linked too; parts of a sentence that are no line are
not. The parent of a message is what it quotes at its
lowest linked level: the message with most linked paragraphs, the latest of
several. Messages come back without quotes, in reply order: each root's
replies stay together, and a reply comes after what it replies to.

The original of a hash is a minimum (summed map-side), and each quoted paragraph
meets that one row, so a passage that is in very many messages makes no pairs.
Roots are found by pointer doubling, the order by a distributed running total.

Defined cases: a null text is a message without lines; a message that quotes
nothing known is a root; quotes of itself or of later messages are not linked;
rows with a null thread or position are returned unlinked with null order;
repeated rows (same thread and position) are one message, the smallest text
counts, and every such row gets the same links; extra columns that have the name
of an added one get a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepref.llm.common import make_way, materialize, one_of, running_total

# A line that introduces a quote ("On Monday, A wrote:").
INTRODUCTION = r"(?i)^\s*(on|am|le|el)\b.{0,200}:\s*$|^.{0,100}\b(wrote|said|writes|schrieb|a écrit|escribió)\s*:\s*$"
# Lines and sentences below this many characters link nothing by themselves.
MIN_UNIT = 10
_CUT, _LEVEL = "\u0002", "\u0001"


def parsed_lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""
    clean = F.translate(F.coalesce(text, F.lit("")), _CUT + _LEVEL, "  ")

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, "^[ \\t>]*", 0)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        quoted = level > 0
        rest = F.substring(x, F.length(marks) + 1, F.length(x))
        return F.struct(level.alias("level"), F.when(quoted, rest).otherwise(x).alias("body"))

    return F.transform(F.split(clean, "\r\n|\r|\n"), line)


def own_text(lines: Column) -> Column:
    """The unquoted lines, without those that introduce a quote, outer blank lines gone."""
    own = F.filter(F.transform(lines, lambda x, i: F.struct(
        x["body"].alias("body"), ((x["level"] == 0) & ~(
            (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0) & x["body"].rlike(INTRODUCTION))).alias("own"))),
        lambda x: x["own"])
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def paragraphs(lines: Column) -> Column:
    """array<string> of "level LEVEL text", one per run of non-blank lines of a level."""
    def piece(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        blank = F.trim(F.translate(x["body"], "\t", " ")) == ""
        follows = ((i > 0) & (before["level"] == x["level"])
                   & (F.trim(F.translate(before["body"], "\t", " ")) != ""))
        head = F.when(follows, F.lit("\n")).otherwise(F.concat(F.lit(_CUT), x["level"].cast("string"), F.lit(_LEVEL)))
        skip = (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > x["level"]) & x["body"].rlike(INTRODUCTION)
        return F.when(blank | skip, F.lit("")).otherwise(F.concat(head, x["body"]))

    joined = F.array_join(F.transform(lines, piece), "")
    return F.filter(F.split(joined, _CUT), lambda p: p != "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def pieces(messages: DataFrame) -> DataFrame:
    """(thread, position, level, raw, hash) per paragraph of (thread, position, lines)."""
    cut = messages.select("thread", "position", F.explode(paragraphs(F.col("lines"))).alias("p"))
    parts = cut.select("thread", "position", F.substring_index("p", _LEVEL, 1).cast("int").alias("level"),
                       F.substring_index("p", _LEVEL, -1).alias("raw")).withColumn("text", normalised(F.col("raw")))
    return parts.where("text <> ''").withColumn("hash", F.md5(F.col("text").cast("binary"))).drop("text")


def passages(messages: DataFrame) -> DataFrame:
    """(thread, position, level, hash, n) of the paragraphs of (thread, position, lines)."""
    return pieces(messages).groupBy("thread", "position", "level", "hash").agg(F.count(F.lit(1)).alias("n"))


def units(raw: Column) -> Column:
    """array<string>: hashes of a paragraph's different lines and sentences."""
    sentences = F.split(normalised(raw), r"(?<=[.!?\u2026])\s+")
    both = F.concat(F.transform(F.split(raw, "\n"), normalised), sentences)
    long = F.filter(both, lambda u: F.length(u) >= MIN_UNIT)
    return F.array_distinct(F.transform(long, lambda u: F.md5(u.cast("binary"))))


def sources(parts: DataFrame) -> DataFrame:
    """(thread, position, level, hash, n, source) of the quoted paragraphs; source is null where there is none."""
    first = parts.where("level = 0").groupBy("thread", "hash").agg(F.min("position").alias("source"))
    quoted = parts.where("level > 0").join(first, ["thread", "hash"], "left")
    return quoted.withColumn("source", F.when(F.col("source") < F.col("position"), F.col("source")))


def partial_sources(messages: DataFrame, lost: DataFrame) -> DataFrame:
    """(thread, position, level, hash, part_source) of those of the quoted paragraphs
    ``lost`` (thread, position, level, hash) of which an earlier message wrote lines
    or sentences: the one with most of them, the latest of several."""
    key = ["thread", "position", "level", "hash"]
    cut = pieces(messages)
    asked = (cut.where("level > 0").join(lost, key, "left_semi")
             .select(*key, F.explode(units(F.col("raw"))).alias("unit")).distinct())
    own = cut.where("level = 0").select("thread", "position", F.explode(units(F.col("raw"))).alias("unit"))
    first = own.groupBy("thread", "unit").agg(F.min("position").alias("source"))
    met = asked.join(first, ["thread", "unit"]).where("source < position").groupBy(*key, "source").agg(F.count(F.lit(1)).alias("m"))
    return met.groupBy(*key).agg(F.max(F.struct("m", "source")).alias("best")).select(*key, F.col("best.source").alias("part_source"))


def reply_links(quoted: DataFrame) -> DataFrame:
    """(thread, position, parent, n_quoted, n_linked) of messages that quote."""
    per = quoted.groupBy("thread", "position", "level", "source").agg(F.sum("n").alias("n"))
    linked = F.col("source").isNotNull()
    best = F.max(F.when(linked, F.struct((-F.col("level")).alias("l"), F.col("n").alias("n"), F.col("source").alias("source"))))
    return per.groupBy("thread", "position").agg(best.alias("best"), F.sum("n").alias("n_quoted"),
                                                 F.sum(F.when(linked, F.col("n")).otherwise(0)).alias("n_linked")).select(
        "thread", "position", F.col("best.source").alias("parent"), "n_quoted", "n_linked")


def roots(tree: DataFrame) -> DataFrame:
    """(thread, position, parent) -> (thread, position, root, depth) by pointer
    doubling: as many rounds as the depth has binary digits, and in each only the
    messages that don't yet point at their root."""
    child = F.col("parent").isNotNull()
    at = materialize(tree.select("thread", "position", F.coalesce("parent", "position").alias("root"),
                                 child.cast("bigint").alias("depth"), (~child).alias("done")))
    while True:
        active = at.where("not done")
        if active.isEmpty():
            return at.drop("done")
        up = at.select("thread", F.col("position").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"),
                       F.col("done").alias("ends"))
        step = active.join(up, ["thread", "root"]).select(
            "thread", "position", F.col("above").alias("root"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("ends").alias("done"))
        at = materialize(at.where("done").unionByName(step))


def link(messages: DataFrame, thread: str = "conv_id", position: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with columns own_text, parent, root, depth, reply_order (from 1
    within the thread), n_quoted and n_linked."""
    messages = make_way(messages, ("own_text", "parent", "root", "depth", "reply_order", "n_quoted", "n_linked"))
    key = [F.col(f"`{thread}`").alias("thread"), F.col(f"`{position}`").cast("bigint").alias("position")]
    rows = messages.select(*key, F.col(f"`{text}`").cast("string").alias("text"))
    known = rows.where("thread is not null and position is not null").groupBy("thread", "position").agg(F.min("text").alias("text"))
    lines = known.select("thread", "position", parsed_lines(F.col("text")).alias("lines"))
    quoted = materialize(sources(materialize(passages(lines))))
    lost = quoted.where("source is null").select("thread", "position", "level", "hash")
    if not lost.isEmpty():
        quoted = quoted.join(partial_sources(lines, lost), ["thread", "position", "level", "hash"], "left")
        quoted = quoted.withColumn("source", F.coalesce("source", "part_source")).drop("part_source")
    links = reply_links(quoted)
    tree = materialize(known.select("thread", "position").join(links, ["thread", "position"], "left"))
    placed = roots(tree).withColumn("one", F.lit(1).cast("bigint"))
    ordered = running_total(placed, ["thread"], ["root", "position"], "one", "reply_order").drop("one")
    told = materialize(ordered.join(tree, ["thread", "position"]))
    kt, kp, kl = (one_of(messages.columns, c) for c in ("_thread", "_position", "_lines"))
    out = messages.withColumns({kt: F.col(f"`{thread}`"), kp: F.col(f"`{position}`").cast("bigint")})
    told = told.select(F.col("thread").alias(kt), F.col("position").alias(kp), "parent", "root", "depth", "reply_order",
                       F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    lines = parsed_lines(F.col(f"`{text}`").cast("string"))
    return (out.join(told, [kt, kp], "left").withColumn(kl, lines).withColumn("own_text", own_text(F.col(kl)))
            .drop(kt, kp, kl))


def quoting_thread(messages: DataFrame) -> DataFrame:
    """Messages as mail: each turn quotes the one before it, and that one's quote
    of the turn before. Keys are joined, so no conversation is one task's."""
    one = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def earlier(n: int, name: str) -> DataFrame:
        return one.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(name))

    def marked(col: str, mark: str) -> Column:
        return F.when(F.coalesce(F.length(col), F.lit(0)) > 0,
                      F.concat(F.lit(mark), F.regexp_replace(col, "\r\n|\r|\n", "\n" + mark), F.lit("\n")))

    both = messages.join(earlier(1, "_last"), ["conv_id", "turn"], "left").join(earlier(2, "_older"), ["conv_id", "turn"], "left")
    quote = F.concat(F.coalesce(marked("_older", "> > "), F.lit("")), F.coalesce(marked("_last", "> "), F.lit("")))
    text = F.when(F.col("_last").isNull(), F.col("text")).otherwise(
        F.concat(F.lit("They wrote:\n"), quote, F.lit("\n"), F.coalesce("text", F.lit(""))))
    return both.withColumn("text", text).drop("_last", "_older")
