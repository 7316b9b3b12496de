"""WARC archives: writing, reading, and transaction assembly.

Writing: Spark's text writer with the record terminator (two CRLFs) as its line
separator; a row is one record, so files are plain WARC, compressed as asked.

Reading: Spark's text reader cuts at the word "WARC/", so memory holds one record
at a time. A header or payload that itself holds the word comes in several
pieces; a header goes on up to its blank line, a payload by its Content-Length.
So the pieces of a file are framed in order by one task: gzipped files are never
split, and the pieces of other files, which are read in splits, are brought
together by file and put in order.

Assembly: request, response and metadata records of one capture name each other
in WARC-Concurrent-To, in either direction. Captures (response, revisit,
resource, conversion) get the records that name them or that they name, as one
nested row each.

Defined cases: null html is an empty payload; records are named by page_id, payload and
url, so pages that share an id have records of their own and only equal rows share
names; a page without an id counts as smaller than all others; a record without an id, or a record
that names no capture, is in no transaction; equal ids within an archive are one
record each and all join; records cut off at the end of a file are marked
truncated and keep what is there; an empty archive has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
VERSION = "WARC/1.1"
CAPTURES = ("response", "revisit", "resource", "conversion")
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"

RECORD = ("record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
          "payload_digest string, content_type string, headers map<string,string>, content_length bigint, "
          "truncated boolean, block binary")
_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                     ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                     ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
                     ("content_length", pa.int64()), ("truncated", pa.bool_()), ("block", pa.binary())])


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                           for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def record(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """The text of a WARC record, without its terminator. Null fields are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in
             [("WARC-Type", kind), *fields, ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.lit(VERSION + CRLF), F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def payloads(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with sha1, bytes and, for a page whose payload a
    larger page_id has too, that page as ``original``. Only digests travel."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("html")).select(
        "*", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").cast("bigint").alias("bytes"))
    long = known.select("page_id", "url", "sha1", "bytes").where(F.col("bytes") >= min_bytes)
    # nulls are smallest; of equal page_ids all are responses, and the largest url is referred to
    top = F.max(F.struct("page_id", "url")).alias("top")
    shared = long.groupBy("sha1", "bytes").agg(top, F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1").select("sha1", "bytes", F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url"))
    later = F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("original") > F.col("page_id")))
    return known.join(shared, ["sha1", "bytes"], "left").withColumn("original", F.when(later, F.col("original")))


def page_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One text per WARC record: for each page a request, a response (or a revisit
    without the payload) and a metadata record."""
    p = payloads(pages, min_bytes)
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    again = F.col("original").isNotNull()
    named = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "sha1", "url")
    capture = _urn("response", named)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(DATE)), ("X-Page-Id", F.col("page_id").cast("string"))]
    main = record(F.when(again, "revisit").otherwise("response"), [
        ("WARC-Record-ID", capture), *common,
        ("WARC-Refers-To", F.when(again, _urn("response", F.concat_ws(
            " ", F.col("original").cast("string"), "sha1", "original_url")))),
        ("X-Refers-To-Page-Id", F.col("original").cast("string")),
        ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(again, http).otherwise(F.concat(http, F.col("html"))))
    path = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(uri, r"^[a-z]+://([^/]*)", 1)
    request = record(F.lit("request"), [
        ("WARC-Record-ID", _urn("request", named)), *common, ("WARC-Concurrent-To", capture),
        ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)))
    metadata = record(F.lit("metadata"), [
        ("WARC-Record-ID", _urn("metadata", named)), *common, ("WARC-Concurrent-To", capture),
        ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit(CRLF)))
    return p.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archives(records: DataFrame, path: str, compression: str = "gzip", per_file: int = 50_000) -> None:
    (records.write.mode("overwrite").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file)
     .option("compression", compression).text(path))


_HEAD = re.compile(rb"^(1\.\d)\r?\n")


def _parse(raw: bytes, payload: bool) -> tuple[dict | None, int]:
    """The record in ``raw`` (after "WARC/") and how many bytes of it are missing."""
    end = raw.find(b"\r\n\r\n")
    if not _HEAD.match(raw) or end < 0:
        return None, 0
    fields: list[tuple[str, str]] = []
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and fields:  # a folded line goes on with the field before
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append((name.strip().lower(), value.strip()))
    first = dict(reversed(fields))
    try:
        length = int(first.get("content-length", ""))
    except ValueError:
        length = len(raw) - end - 4
    block = raw[end + 4:end + 4 + length]
    missing = length - len(block)
    return {"record_id": first.get("warc-record-id"), "type": (first.get("warc-type") or "").lower(),
            "target_uri": first.get("warc-target-uri"), "date": first.get("warc-date"),
            "concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"], "refers_to": first.get("warc-refers-to"),
            "payload_digest": first.get("warc-payload-digest"), "content_type": first.get("content-type"),
            "headers": list(first.items()), "content_length": length, "truncated": missing > 0,
            "block": block if payload else None}, missing


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; without ``payload`` the blocks
    are framed and checked but not kept."""
    cut = spark.read.option("lineSep", "WARC/").text(path)
    pieces = cut.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("at"),
                        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))
    unsplit = [f.endswith(".gz") for f in cut.inputFiles()]
    if not all(unsplit):
        gzipped = F.col("at").endswith(".gz")
        ordered = pieces.where(~gzipped).repartition("at").sortWithinPartitions("at", "split", "nth")
        pieces = [pieces.where(gzipped), ordered] if any(unsplit) else [ordered]
    else:
        pieces = [pieces]

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where = bytearray(), None
        heading, missing = False, 0  # in a header that has no blank line yet; bytes missing of the payload

        def done():
            parsed, _ = _parse(bytes(held), payload)
            return [parsed] if parsed else []

        for batch in batches:
            out: list[dict] = []
            for value, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = value or b""
                if at == where and missing > 0:
                    held += b"WARC/" + value  # the payload holds the version word
                    missing -= 5 + len(value)
                    continue
                # a version line of its own can't be in a header: there a new record starts
                if at == where and heading and not (held.endswith(b"\n") and _HEAD.match(value)):
                    seen = max(0, len(held) - 3)
                    held += b"WARC/" + value  # the header does
                    heading = held.find(b"\r\n\r\n", seen) < 0
                    missing = 0 if heading else _parse(bytes(held), False)[1]
                    continue
                out += done()
                held, where = bytearray(value), at
                parsed, missing = _parse(value, False)
                heading = parsed is None and _HEAD.match(value) is not None
                if parsed is None and not heading:
                    held = bytearray()
            if out:
                yield pa.RecordBatch.from_pylist(out, _RECORD)
        if last := done():
            yield pa.RecordBatch.from_pylist(last, _RECORD)

    return reduce(DataFrame.unionByName, [p.select("value", "at").mapInArrow(frame, RECORD) for p in pieces])


def http_payload(block: Column) -> Column:
    """The body after the HTTP headers of a response record's block."""
    text = block.cast("binary")
    at = F.instr(F.decode(text, "ISO-8859-1"), CRLF + CRLF)
    return F.when(at > 0, F.substring(text, at + 4, F.length(text))).otherwise(text)


def assemble(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per capture: the capture's columns (``keep``), and ``requests`` and
    ``metadata`` as arrays of its concurrent records' structs."""
    keep = keep or [c for c in records.columns]
    captures = records.where(F.col("type").isin(*CAPTURES) & F.col("record_id").isNotNull())
    side = records.where(F.col("type").isin("request", "metadata") & F.col("record_id").isNotNull())
    small = ["record_id", "type", "target_uri", "date", "content_type", "content_length", "block"]
    out = side.select(F.struct(*small).alias("s"), F.col("record_id").alias("side"), F.explode("concurrent_to").alias("to"))
    # a record is concurrent to a capture by its own naming ...
    ids = captures.select(F.col("record_id").alias("capture"), "concurrent_to")
    direct = out.join(ids.select("capture").distinct(), out["to"] == F.col("capture")).select("capture", "side", "s")
    # ... or by the capture's
    named = ids.select("capture", F.explode("concurrent_to").alias("side"))
    whole = side.select(F.struct(*small).alias("s"), F.col("record_id").alias("side"))
    sides = direct.unionByName(named.join(whole, "side").select("capture", "side", "s")).dropDuplicates(["capture", "side"])
    grouped = sides.groupBy("capture").agg(
        F.sort_array(F.collect_list(F.when(F.col("s.type") == "request", F.col("s")))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("s.type") == "metadata", F.col("s")))).alias("metadata"))
    empty = F.array().cast(grouped.schema["requests"].dataType)
    return (captures.join(grouped, captures["record_id"] == grouped["capture"], "left").select(
        *[captures[c] for c in keep], F.coalesce("requests", empty).alias("requests"),
        F.coalesce("metadata", empty).alias("metadata")))
