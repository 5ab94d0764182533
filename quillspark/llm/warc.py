"""WARC archives with revisit records, written by Spark and read back from the files.

resolve() shuffles (digest, page_id) headers by payload digest and joins each page to the smallest page_id of its
digest: that page is the response, the others of min_bytes or more revisit it. write_archives() then writes one record a
page with fresh headers (a revisit carries no payload), and read_archives() parses the files by Content-Length.

The archives are gzip files of whole records: the text writer puts a record a line and its line separator is the
record end CR LF CR LF, so payloads may hold any text. The writer makes each file one gzip member, not one for each record.
Reading splits a file at CR LF CR LF wherever it stands, puts the pieces together again in their order and cuts records by
their lengths, so a worker holds one record, not an archive.

Defined cases: a null html is an empty payload; a null url gives the target urn:page:ID; a null page_id orders last
(it responds only if no page of its digest has an id); a row repeated with the smallest page_id of its digest is a
response each time; rows of one page_id may differ; an empty table writes no records. Only page_id, url and html are read.

Scale: pages are read twice, for headers (written once, with the SHA-1) and for payloads. The digest join moves headers
alone; minima and record types are written before they are joined, so both sides of each join are plain shuffles and AQE
splits a hot digest or page_id. Payloads are shuffled once, by page_id. An archive is cut at about ARCHIVE_BYTES, by the mean size of a record.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.frames import materialise, new_path, tune
from quillspark.state import scoped

ARCHIVE_BYTES = 128 << 20
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 5 hexadecimal digits are 4 digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substr(digest, F.lit(1 + 5 * i), F.lit(5)), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payload() -> Column:
    return F.coalesce("html", F.lit(""))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, key (a hash of the payload, to find its row again), payload_bytes, payload_digest."""
    raw = _payload().cast("binary")
    return pages.select("page_id", F.xxhash64(_payload()).alias("key"), F.octet_length(raw).cast("long").alias("payload_bytes"), base32_sha1(raw).alias("payload_digest"))


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, key, payload_bytes, payload_digest, record_type, refers_to, a row for each different (page_id, payload)."""
    firsts = materialise(heads.groupBy("payload_digest").agg(F.min("page_id").alias("first")), "firsts")
    first = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("payload_bytes") < min_bytes)
    return heads.join(firsts.hint("merge"), "payload_digest").select(
        "page_id", "key", "payload_bytes", "payload_digest", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("first")).alias("refers_to")
    ).distinct()


def _uri(url: Column, page_id: Column) -> Column:
    clean = F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")
    return F.when(F.length(clean) > 0, clean).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("none"))).cast("binary"))
    at = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *at), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages' records under path, dated date (the present time if None)."""
    tune(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = materialise(headers(pages), "headers")
    kinds = materialise(resolve(heads, min_bytes), "kinds").withColumnRenamed("page_id", "id").withColumnRenamed("key", "own")
    mean = heads.agg(F.avg("payload_bytes")).first()[0] or 0
    full = pages.select("page_id", _uri(F.col("url"), F.col("page_id")).alias("uri"), _payload().alias("html"), F.xxhash64(_payload()).alias("key"))
    rows = full.join(kinds.hint("merge"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("own")) & (F.octet_length("html") == F.col("payload_bytes"))).withColumnRenamed("payload_bytes", "bytes")
    response = F.col("record_type") == "response"
    http = F.concat(F.lit(HTTP + "Content-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(response, F.col("html")).otherwise(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, "").otherwise(
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", _record_id(F.col("refers_to"))), F.coalesce(line("X-Refers-To-Page", F.col("refers_to").cast("string")), F.lit(""))
            )
        ),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes / (mean + 500)))).text(path)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of archives that come as what stands between their CR LF CR LF.

    A cut is made at the first CR LF CR LF, so only what is left at the end of a file, with no record end behind it, can end in CR LF.
    """
    pieces, held = iter(pieces), bytearray()

    def whole(piece: bytes) -> bytes:
        return piece if piece.endswith(END[:2]) else piece + END

    def hold(size: int) -> None:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("an archive ends within a record")
            held.extend(whole(piece))

    for piece in pieces:
        held += whole(piece)
        while held:
            while (to := held.find(END)) < 0:
                hold(len(held) + 1)
            first, *lines = bytes(held[:to]).decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record at {first[:40]!r}")
            fields = dict(x.split(": ", 1) for x in lines)
            end = to + len(END) + int(fields["Content-Length"])
            hold(end + len(END))
            if held[end : end + len(END)] != END:
                raise ValueError(f"{fields['WARC-Record-ID']} has another length than it says")
            yield fields, bytes(held[to + len(END) : end])
            del held[: end + len(END)]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; a response's digest is checked."""
    tune(spark)

    def row(h: dict[str, str], block: bytes) -> tuple:
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(h["X-Payload-Length"])
        if h["WARC-Type"] == "response":
            payload = block[block.index(END) + len(END) :]
            size = len(payload)
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload and digest differ in {h['WARC-Record-ID']}")
        number = lambda name: int(h[name]) if name in h else None
        return number("X-Page-Id"), size, digest, h["WARC-Type"], number("X-Refers-To-Page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (x.as_buffer().to_pybytes() for batch in batches for x in batch.column(0))
        records = (row(h, block) for h, block in parse(pieces))
        while some := list(itertools.islice(records, 2048)):
            ids, sizes, digests, kinds, refers = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(kinds), pa.array(refers, pa.int64())], names=[x.split()[0] for x in READ.split(", ")])

    # a gzip file is never split, and a task reads its files one behind the other, so the pieces come in order
    return spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.gz").text(path).mapInArrow(run, READ)


@scoped
def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives into the shared folder and read them."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    translate(upper(""" + " || ".join(f"lpad(to_base(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT, 32), 4, '0')" for i in range(8)) + """), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
), m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""
