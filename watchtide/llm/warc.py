"""WARC archives of captured pages, and transactions put together from their records.

Every page becomes three records: the request, the response (or a revisit of an equal payload), and metadata.  Request
and metadata name the response by WARC-Concurrent-To, a revisit names its response by WARC-Refers-To; reading joins
the records on these identifiers into one nested row per capture.  Spark's text writer and binary file reader carry the
archives, with the end of a record as line separator, so that they may lie in any store.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchtide.llm import common

VERSION = "WARC/1.1"
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"  # the given pages carry no time
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 4000  # captures in one archive file, at most


def base32(hex_digest: Column) -> Column:
    """Upper-case base 32 of a SHA-1 in hexadecimal: four groups of 40 bits, eight letters each."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(md5: Column) -> Column:
    parts = [F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, *headers: tuple[str, Column | str]) -> Column:
    """One record without its end; a header whose value is null is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the archives of ``pages``; a null payload is empty, a null address leaves its header out.

    Of rows with equal payloads of at least ``least_bytes`` the one with the smallest id is the response and the others
    revisit it (a null id is smallest); among repeated rows with the same id and payload exactly one can be it.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col).cast("string"), "[\\r\\n]", "").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", "html", F.sha1("html").alias("sha1"), F.monotonically_increasing_id().alias("rid"))
    slim = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha1", "page_id").agg(F.min("rid").alias("rid"), F.count("*").alias("same"))
    equal = slim.groupBy("sha1").agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "rid", "same")).alias("first"),
                                     F.sum("same").alias("times")).where("times > 1")
    # written, so that Spark knows its size: small, it goes to the pages; large, the pages are shuffled by digest
    equal = common.staged(equal.select(F.col("sha1").alias("equal_sha1"), "first"), "warc-equal")
    rows = rows.join(equal, F.col("sha1") == F.col("equal_sha1"), "left")
    again = F.col("first").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & ((F.col("first.same") == 1) | (F.col("first.rid") == F.col("rid"))))
    rows = rows.select("page_id", "url", "html", "sha1", again.alias("again"), F.when(F.col("first").isNull() | again, F.uuid()).alias("own"))

    # the response of a group of equal payloads has an identifier that follows from the payload
    shared = _urn(F.md5(F.concat(F.lit("response "), F.col("sha1"))))
    main_id = F.when(F.col("own").isNull(), shared).otherwise(F.concat(F.lit("<urn:uuid:"), F.col("own"), F.lit(">")))
    target, digest = F.col("url"), F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    uri = F.coalesce(target, F.lit(""))
    host, place = F.regexp_extract(uri, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(uri, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(place == "", F.lit("/")).otherwise(place), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("tool: batch"))
    request = _record("request", _urn(F.md5(F.concat(F.lit("request "), F.col("main_id")))), asked, ("WARC-Concurrent-To", F.col("main_id")),
                      ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=request"))
    response = _record(F.when(F.col("again"), "revisit").otherwise("response"), F.col("main_id"), F.when(F.col("again"), head).otherwise(F.concat(head, F.col("html"))),
                       ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(F.col("again"), shared)),
                       ("WARC-Profile", F.when(F.col("again"), PROFILE)), ("Content-Type", "application/http; msgtype=response"))
    metadata = _record("metadata", _urn(F.md5(F.concat(F.lit("metadata "), F.col("main_id")))), fields, ("WARC-Concurrent-To", F.col("main_id")),
                       ("WARC-Target-URI", target), ("Content-Type", "application/warc-fields"))
    rows.withColumn("main_id", main_id).select(F.concat_ws(END, request, response, metadata).alias("value")).write.option(
        "lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _unzipped(blob: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    parts = []
    while blob[:2] == b"\x1f\x8b":
        tool = zlib.decompressobj(31)
        parts.append(tool.decompress(blob))
        blob = tool.unused_data
    return b"".join(parts) if parts else blob


def parse(blob: bytes) -> Iterator[tuple[dict, memoryview]]:
    """Headers (names in lower case) and block of each record of an unzipped archive."""
    at, view = 0, memoryview(blob)
    while at < len(blob):
        stop = blob.find(b"\r\n\r\n", at)
        if stop < 0 or not blob.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in blob[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        start = stop + 4
        end = start + int(headers["content-length"])
        if blob[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, view[start:end]
        at = end + 4


FIELDS = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, content_type string"
MAIN = FIELDS + ", status int, payload_bytes long, payload_digest string, digest_holds boolean, payload binary"


def records(spark: SparkSession, path: str, kinds: tuple[str, ...], with_payload: bool = False) -> DataFrame:
    """Records of ``kinds``.  Responses and revisits get the status, length and base-32 SHA-1 of their payload; the
    length and digest of a response are taken from its bytes and compared with its headers, those of a revisit are
    what its headers say.  Other kinds get their block as ``block``.
    """
    main = "response" in kinds
    names = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "content-type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse(_unzipped(content.as_py())):
                    if headers["warc-type"] not in kinds:
                        continue
                    row = [headers.get(n) for n in names]
                    if not main:
                        rows.append([*row, bytes(block)])
                        continue
                    whole = bytes(block)
                    head, _, payload = whole.partition(b"\r\n\r\n")
                    lines = head.split(b"\r\n")
                    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
                    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    status = int(lines[0].split(b" ")[1])
                    if headers["warc-type"] == "revisit":
                        rows.append([*row, status, int(said[b"content-length"]), told, None, None])
                    else:
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        holds = digest == told and len(payload) == int(said[b"content-length"])
                        rows.append([*row, status, len(payload), digest, holds, payload if with_payload else None])
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows[at:at + 1000]), types)], names=labels)

    schema = MAIN if main else FIELDS + ", block binary"
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    labels, types = zip(*((x.split()[0], arrow[x.split()[1]]) for x in schema.split(", ")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, schema)


def captures(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One nested row per capture: page_id, main, request, metadata, refers_to, refers_to_id.

    ``main`` is the response or revisit record, ``refers_to`` the page of the response that a revisit stands for and
    ``refers_to_id`` its record.  A capture whose request or metadata record is missing keeps null there, a record
    without its response is no capture; no archives give no rows.
    """
    slim = [x.split()[0] for x in FIELDS.split(", ")]
    main = records(spark, path, ("response", "revisit"), with_payload)
    main = main.select(F.col("record_id"), F.struct(*main.columns).alias("main"))
    other = records(spark, path, ("request", "metadata"))
    asked = other.where("record_type = 'request'").select(F.col("concurrent_to").alias("asked_for"), F.struct(*slim, "block").alias("request"))
    number = F.regexp_extract(F.col("block").cast("string"), r"(?m)^page-id: (-?\d+)\r?$", 1)
    told = other.where("record_type = 'metadata'").select(
        F.col("concurrent_to").alias("told_of"), F.when(number != "", number.cast("long")).alias("page_id"), F.struct(*slim, "block").alias("metadata"))
    whole = main.join(asked, F.col("record_id") == F.col("asked_for"), "left").join(told, F.col("record_id") == F.col("told_of"), "left")
    pages = told.select(F.col("told_of").alias("response_id"), F.col("page_id").alias("response_page"))
    whole = whole.withColumn("refers_to_id", F.col("main.refers_to")).join(pages, F.col("refers_to_id") == F.col("response_id"), "left")
    return whole.select("page_id", "main", "request", "metadata", F.col("response_page").alias("refers_to"), "refers_to_id")
