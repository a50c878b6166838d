"""WARC archives with revisit resolution.

Headers (page, payload digest, length) without payloads are grouped by
payload digest; the record of the largest page_id of each digest is the
response, the others become revisits of it.  The archives are written with
fresh headers: a response carries its payload, a revisit refers to the
response and carries none.

A record is one row of bytes written by Spark's text writer with the
separator of WARC records (two line ends), one gzipped archive per output
file; files are cut by record count so that one archive has about
``archive_bytes`` of payload.  Archives are read back whole, one per row, by
their Content-Length fields, so payloads may hold any bytes.

Defined results: a null payload is the empty payload, which takes part like
others (``min_bytes`` 0); payloads under ``min_bytes`` are all responses; rows
with one page_id and one payload share their role, so all rows of the
response's page_id are responses; rows without page_id are responses that
nothing refers to, unless a page with the payload exists; null urls are
written empty and read back null; an empty table writes no archive; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimctx.llm.common import arrow_batches, join_unique
from slimctx.session import materialize, scratch_dir

ARCHIVE_BYTES = 16_000_000
CRLF = "\r\n"
#: RFC 4648, and the digits of conv() in base 32.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
VERSION = "WARC/1.1"
#: The seconds of the years 1970 to 9999; record dates are page ids modulo these.
DATE_SECONDS = 253_402_300_800
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
URN = "urn:x-page:"
READ_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, "
               "payload_digest string, refers_to long, block_bytes long, intact boolean")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits, five hex digits, at a time."""
    hexa = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes), no payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", base32_sha1(payload).alias("payload_digest"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"))


def resolve_revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, original) of every page that revisits another.

    The digests are summed before they are shuffled; a digest that holds a
    large part of all pages is joined by a bounded broadcast."""
    heads = materialize(heads.filter(F.col("payload_bytes") >= min_bytes), "heads")
    shared = (heads.groupBy("payload_digest")
              .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
              .filter("n > 1 and original is not null"))
    pairs = join_unique(heads, shared, ["payload_digest"], "n", heads.count())
    return (pairs.filter("page_id is null or page_id < original")
            .select("page_id", "payload_digest", "original").distinct())


def _record() -> Column:
    """The bytes of a record, from page_id, url, html, payload_digest, original."""
    revisit = F.col("original").isNotNull()
    html = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit("")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    length = F.octet_length(html) + len(HTTP)
    seconds = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)).cast("long"), F.lit(DATE_SECONDS))
    stamp = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{URN}"), page, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), stamp),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{URN}"),
                                 F.col("original").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF + HTTP), html)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``."""
    heads = materialize(headers(pages), "heads")
    revisits = resolve_revisits(heads, min_bytes)
    size = heads.agg(F.sum("payload_bytes").alias("b"), F.count("*").alias("n")).first()
    per_file = max(1, int(archive_bytes * size["n"] / max(size["b"] or 1, 1)))
    # the digest is part of the key, so rows with one page_id and several
    # payloads keep their own roles; without page_id the payload alone decides
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", F.url_encode(F.coalesce("url", F.lit(""))).alias("uri"), "html",
                        base32_sha1(payload).alias("payload_digest"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"))
    on = (F.col("p.page_id").eqNullSafe(F.col("r.page_id"))
          & (F.col("p.payload_digest") == F.col("r.payload_digest")))
    rows = full.alias("p").join(revisits.alias("r"), on, "left").select(
        "p.page_id", "uri", "html", "p.payload_digest", "payload_bytes", "original")
    (rows.select(_record().alias("value")).write.mode("overwrite")
     .option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an unzipped archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode("utf-8").split(CRLF)
        if first != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
        begin = end + 4
        stop = begin + int(fields["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[begin:stop]
        at = stop + 4


def _page(uri: str | None) -> int | None:
    page = uri[1:-1].removeprefix(URN) if uri else "none"
    return None if page == "none" else int(page)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, READ_SCHEMA.split(", "))])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for h, block in parse_archive(gzip.decompress(content.as_buffer())):
                payload = memoryview(block)[block.index(b"\r\n\r\n") + 4:]
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                response = h["WARC-Type"] == "response"
                intact = not response or (
                    int(h["X-Payload-Length"]) == len(payload)
                    and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
                rows.append((_page(h["WARC-Record-ID"]),
                             unquote(h["WARC-Target-URI"].replace("+", " ")) or None,
                             h["WARC-Type"], int(h["X-Payload-Length"]), digest,
                             _page(h.get("WARC-Refers-To")), len(payload), intact))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                if rows else [pa.array([], f.type) for f in schema], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; ``intact`` tells
    whether the payload of a response has the digest and length it declares."""
    arrow_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, READ_SCHEMA)


def op9_query(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read the archives back."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest",
                                             "record_type", "refers_to", "intact")


OP9_SQL = r"""
WITH h AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS hexa FROM pages
), g AS (
  SELECT page_id, payload_bytes, hexa, list_transform(range(0, 8), lambda i: list_reduce(
    list_transform(range(1, 6), lambda j: strpos('0123456789abcdef', hexa[5 * i + j]) - 1),
    lambda x, y: 16 * x + y)) AS v FROM h
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda q:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[q // 4 + 1] >> (15 - 5 * (q % 4))) & 31) + 1]), '')
    AS payload_digest FROM g
), o AS (
  SELECT payload_digest, max(page_id) AS original FROM d GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to, true AS intact
FROM d JOIN o USING (payload_digest)
"""
