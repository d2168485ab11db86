"""WARC archives with revisit resolution.

``write_archives`` turns pages into WARC/1.1 records.  Payload digests are
shuffled, never payload groups: the first page of each digest becomes a
``response``, the others become ``revisit`` records that refer to it and carry
no payload.  Every record is a gzip member of its own.  A task gathers members
up to FILE_BYTES and hands them to Spark's text writer as one row, which becomes
one file, so the writer's commit protocol covers lost executors.
``read_archives`` takes the files member by member and parses records by their
Content-Length headers, and ``resolve_revisits`` joins the revisits to their
responses.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, text_bytes

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Compressed bytes from which a file is full; one record more than that may be in it.
FILE_BYTES = 16 << 20
READ = "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_record string, actual_digest string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of bytes: eight characters for every ten hex digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, digest: Column) -> Column:
    """A name for a record that every run gives the same page and payload; rows that repeat both share it."""
    h = F.sha1(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(13, 3), F.lit("-8"), cut(16, 3), F.lit("-"), cut(19, 12))


def resolve_payloads(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Pages with ``payload, payload_bytes, payload_digest, response_id, is_response``.

    Of equal payloads of at least ``min_payload`` bytes, the row with the smallest
    page_id is the response; rows that repeat that page_id are responses as well.
    A null html is an empty payload.  A null page_id is larger than any other.
    """
    rows = pages.select("page_id", "url", text_bytes("html").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    long_enough = F.col("payload_bytes") >= min_payload
    headers = rows.filter(long_enough).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # only digests that repeat travel back; an unrepeated payload is its own response
    headers = headers.filter("copies > 1").drop("copies")
    rows = rows.join(headers, ["payload_digest", "payload_bytes"], "left")
    known = F.col("first_id").isNotNull()
    return rows.withColumn("is_response", ~known | F.col("page_id").eqNullSafe(F.col("first_id"))).withColumn("response_id", F.when(known, F.col("first_id")).otherwise(F.col("page_id")))


def _header(name: str, value: Column) -> Column:
    clean = F.regexp_replace(value, "[\\x00-\\x1f\\x7f]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        for head, body in zip(batch["head"], batch["body"], strict=True):
            pack = zlib.compressobj(6, wbits=31)
            held.append(pack.compress(head.encode()) + pack.compress(body) + pack.compress(b"\r\n\r\n") + pack.flush())
            size += len(held[-1])
            if size >= FILE_BYTES:
                yield pd.DataFrame({"value": [b"".join(held)]})
                held, size = [], 0
    if held:
        yield pd.DataFrame({"value": [b"".join(held)]})


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_payload: int = 0) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html; other columns are ignored).

    Control characters of a url become spaces; a null url has no header.  Pages
    that repeat a page_id have a record each, told apart by their payload.  An
    empty table gives no archive.
    """
    rows = resolve_payloads(pages, min_payload)
    response = F.col("is_response")
    size = F.lit(len(HTTP)) + F.when(response, F.col("payload_bytes")).otherwise(F.lit(0))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(response, F.lit("response")).otherwise(F.lit("revisit")), F.lit(CRLF),
        F.lit("WARC-Record-ID: <"), record_id(F.col("page_id"), F.col("payload_digest")), F.lit(f">{CRLF}WARC-Date: {date}{CRLF}"),
        _header("WARC-Target-URI", F.col("url")),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        F.when(response, F.lit("")).otherwise(
            F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <"), record_id(F.col("response_id"), F.col("payload_digest")), F.lit(f">{CRLF}"))),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
        size.cast("string"), F.lit(CRLF * 2 + HTTP))
    body = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    files = rows.select(head.alias("head"), body.alias("body")).mapInPandas(_archives, "value binary")
    # a gzip member ends with the upper byte of its length, which is 0 below 16 MiB: it is written as the row's end;
    # behind a longer last record it is one 0 too many, which readers of gzip skip
    whole = F.when(F.expr("substring(value, -1, 1) = X'00'"), F.expr("substring(value, 1, octet_length(value) - 1)")).otherwise(F.col("value"))
    files.select(whole.cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _members(content: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    rest = memoryview(content)
    while rest and rest[0]:
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if not rest:
                raise ValueError("a gzip member has no end")
            step = rest[: 1 << 20]
            out.append(member.decompress(step))
            rest = rest[len(step) - len(member.unused_data) :]
        yield b"".join(out)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for record in _members(content):
        head, _, block = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record at the start of a member")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        if block[size:] != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        yield fields, block[:size]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in READ.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for head, block in _records(content):
                payload = block.partition(b"\r\n\r\n")[2]
                page = head.get("X-Page-ID")
                response = head["WARC-Type"] == "response"
                rows.append((
                    None if page is None else int(page), head.get("WARC-Target-URI"), head["WARC-Record-ID"][1:-1], head["WARC-Type"],
                    head["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload) if response else None,
                    head["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in head else None,
                    base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else None))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "Int64", "payload_bytes": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``.

    A file is held compressed, FILE_BYTES and a record at most, and its records
    one at a time.  ``actual_digest`` is computed from a response's payload as read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(_parse, READ)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the payload size, digest and page of the response that each stands for."""
    response = F.col("record_type") == "response"
    targets = records.filter(response).groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.min("page_id").alias("t_page"), F.max("payload_bytes").alias("t_bytes"), F.max("actual_digest").alias("t_digest"))
    # written, so that the join below stands alone and a response that many refer to can be split
    targets = Workspace(records.sparkSession, "warc").save(targets, "responses")
    out = records.join(targets, "refers_to_record", "left")
    return out.select(
        "page_id", "url", F.coalesce("payload_bytes", "t_bytes").alias("payload_bytes"),
        F.coalesce("actual_digest", "t_digest").alias("payload_digest"), "record_type",
        F.when(~response, F.col("t_page")).alias("refers_to"))
