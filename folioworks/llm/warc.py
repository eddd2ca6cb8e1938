"""WARC archives of web pages: writing with payload revisits, reading back, and assembling transactions.

``write_archive`` makes a request, a response (or revisit) and a metadata record per page. Spark's text writer puts
the records in files, with the two line ends that close a WARC record as its separator, so each file is a valid WARC
(gzip over the whole file). ``read_records`` reads files as streams and walks the records by their Content-Length.
``assemble`` joins request and metadata records to the record that their WARC-Concurrent-To names, one nested row per capture.

Of pages with equal payloads the one with the largest id is stored, the others are revisits of it, found again by the
payload's digest. Each row has record ids of its own, so each row is one capture.

Defined results: a null html is an empty payload, a null url an empty target; a null page id is smaller than all others, and
where all ids of a payload are null each row is stored; rows that repeat the largest id of a payload are all stored; very
large payloads are held one at a time; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 3_000
#: Places that rows of one payload are dealt to.
SALTS = 16
BATCH_BYTES = 4 << 20
BREAK = "\r\n"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base 32 of a SHA-1 in hex: every five hex digits are four of base 32."""
    pieces = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*pieces)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, row: Column, digest: Column) -> Column:
    """An id for each row: ``row`` tells rows of one table apart."""
    h = F.md5(F.concat_ws(":", F.lit(kind), row.cast("string"), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the line ends that close it; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    size = F.octet_length(block).cast("string")
    return F.concat(F.concat_ws(BREAK, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), size)), F.lit(BREAK * 2), block)


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (record) per WARC record."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]+", " ")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), clean.alias("url"), payload.alias("payload"), base32(F.sha1(payload.cast("binary"))).alias("digest"))
    # of payloads that occur once nothing need be known; those that occur often are dealt to SALTS places
    owners = base.groupBy("digest").agg(F.max("page_id").alias("owner"), F.max_by("url", "page_id").alias("owner_url"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = owners.select("digest", "owner", "owner_url", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    numbered = base.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    rows = numbered.join(spread, ["digest", "salt"], "left")
    me, own = F.col("page_id"), F.col("owner").isNull() | F.col("page_id").eqNullSafe(F.col("owner"))
    rid = record_id("capture", F.col("row"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(BREAK * 2))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    main = _record(
        [
            ("WARC-Type", F.when(own, "response").otherwise("revisit")),
            ("WARC-Record-ID", rid),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(~own, PROFILE)),
            ("WARC-Refers-To-Target-URI", F.when(~own, F.col("owner_url"))),
            ("WARC-Refers-To-Date", F.when(~own, DATE)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(own, F.concat(http, F.col("payload"))).otherwise(http),
    )
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", F.col("row"), F.col("digest"))), *common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)), F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(BREAK * 2)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", F.col("row"), F.col("digest"))), *common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(me.cast("string"), F.lit("")), F.lit(BREAK)),
    )
    return rows.select(F.explode(F.array(request, main, metadata)).alias("record"))


def write_archive(pages: DataFrame, path: str, **columns: str) -> None:
    records = archive_records(pages, **columns)
    records.write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of uncompressed WARCs, one after the other, that come in pieces; header names are
    lower-cased. No more than a record and a piece are held."""
    held = bytearray()

    def filled(size: int | None = None) -> bool:
        """Takes pieces until ``size`` bytes, or the end of a header, are there."""
        nonlocal held
        while (len(held) < size) if size is not None else (BREAK * 2).encode() not in held:
            piece = next(pieces, None)
            if piece is None:
                return False
            held += piece
            if size is None:
                held = held.lstrip(BREAK.encode())  # line ends before a record belong to the one before
        return True

    while filled():
        end = held.index((BREAK * 2).encode())
        headers = {}
        for line in bytes(held[:end]).split(BREAK.encode())[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        if not filled(end + 4 + size):
            raise ValueError("an archive ends within a record")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        filled(end + 8 + size)
        held = held[end + 8 + size :].lstrip(BREAK.encode())


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    return body if found else b""


RECORD = "record_id string, type string, concurrent_to string, refers_to_uri string, target string, digest string, payload_bytes long, page_id long, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives below ``path``; the digest is that of the bytes read where there is a payload.

    Archives are read as a stream of what stands between two line ends, so a task holds a batch and a record, not a file.
    """

    def pieces(batches):
        for batch in batches:
            for piece in batch.column(0):
                yield piece.as_py() + (BREAK * 2).encode()

    def run(batches):
        rows, size = [], 0
        for headers, block in parse_records(pieces(batches)):
            kind, payload, page = headers.get("warc-type"), None, None
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind == "response":
                payload = http_payload(block)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            elif kind == "metadata" and (m := re.search(rb"page-id: (-?\d+)", block)):
                page = int(m[1])
            rows.append((headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to-target-uri"), headers.get("warc-target-uri"), digest, None if payload is None else len(payload), page, payload if with_payload else None))
            size += len(block) if with_payload else 200
            if size > BATCH_BYTES:
                yield record_batch(rows)
                rows, size = [], 0
        yield record_batch(rows)

    def record_batch(rows):
        kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in RECORD.split(", ")])

    return spark.read.option("lineSep", BREAK * 2).text(path).select(F.col("value").cast("binary")).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), requests, metadata, and the response it revisits."""
    whole = F.struct("record_id", "target", "page_id")
    joined = records.filter("concurrent_to is not null and type in ('request', 'metadata')").groupBy(F.col("concurrent_to").alias("capture_id"))
    others = joined.agg(
        F.collect_set(F.when(F.col("type") == "request", whole)).alias("requests"),
        F.collect_set(F.when(F.col("type") == "metadata", whole)).alias("metadata"),
    )
    main = records.filter("type in ('response', 'revisit')")
    responses = main.select(F.col("record_id").alias("capture_id"), F.struct("type", "target", "digest", "payload_bytes", "payload", "refers_to_uri").alias("response"))
    found = responses.join(others, "capture_id", "left").withColumn("page_id", F.get(F.col("metadata.page_id"), F.lit(0)))
    # what a revisit refers to is known by its digest; digests with many revisits are dealt to SALTS places
    again = found.filter("response.type = 'revisit'").select(F.col("response.digest").alias("digest")).distinct()
    stored = found.filter("response.type = 'response'").select(F.col("response.digest").alias("digest"), "page_id", F.col("response.payload_bytes").alias("payload_bytes"))
    stored = stored.join(again, "digest", "left_semi").groupBy("digest").agg(F.max("page_id").alias("page_id"), F.max("payload_bytes").alias("payload_bytes"))
    spread = stored.select(F.col("digest").alias("_digest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.struct("page_id", "digest", "payload_bytes").alias("original"))
    salt = F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")
    found = found.withColumn("_of", F.when(F.col("response.type") == "revisit", F.col("response.digest")))
    return found.join(spread, (F.col("_of") == F.col("_digest")) & (salt == F.col("_salt")), "left").select("page_id", "capture_id", "response", "requests", "metadata", "original")


def captures(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and assembles the captures."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path)
    return assemble(materialise(read_records(spark, path, with_payload), "records"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, h,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, 5 * CAST(i // 4 AS BIGINT) + 1, 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN NULL ELSE max(page_id) OVER (PARTITION BY h) END AS refers_to
FROM d
"""
