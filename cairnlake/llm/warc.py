"""WARC archives: writing with segmentation, chunked framing and revisits, and reading back by segment reassembly.

Records longer than ``segment_bytes`` are written as a first segment and ``continuation`` records. The reader groups
those by origin identifier, orders them by segment number, verifies the total length, joins the blocks and decodes the
chunked transfer framing. Archives are gzipped WARC files that Spark's text sink writes (the separator of WARC records is
its line separator), so any Hadoop file system holds them; ``records_per_file`` bounds a file, hence what a reading
task holds.

Defined results: null html is an empty payload; of records with equal payloads (of at least ``revisit_bytes``) those
with the smallest id are responses and others revisits of it, so rows that repeat the smallest id are all responses; a
row with a null id is a revisit where its payload has another id, else a response; a record whose segments don't add up
is kept with a null payload and its ``problem`` named; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, scratch_path, stored, table

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 4_000
REVISIT_BYTES = 0
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + chunk_bytes] for i in range(0, len(body), chunk_bytes))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing; extensions and trailers are skipped, framing that ends early is a ValueError."""
    at, parts = 0, []
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is shorter than it says")
        parts.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the two line ends that follow it."""
    lines = ["WARC/1.1", *(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(record_id: str, url: str | None, payload: bytes, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record or the segments for one captured page."""
    digest = f"sha1:{bare_digest(payload)}"
    common = [("WARC-Date", CAPTURED), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        more = [("WARC-Payload-Digest", digest), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *common, *more], head)
        return
    block = head + chunked(payload)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    whole = [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", f"sha1:{bare_digest(cuts[0])}")]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *common, *whole]
    yield record([*first, ("WARC-Segment-Number", 1 if len(cuts) > 1 else None)], cuts[0])
    for n, cut in enumerate(cuts[1:], 2):
        total = len(block) if n == len(cuts) else None
        yield record(
            [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), ("WARC-Date", CAPTURED), ("WARC-Target-URI", url),
                ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total),
                ("WARC-Block-Digest", f"sha1:{bare_digest(cut)}"),
            ],
            cut,
        )


def write_archives(
    pages: DataFrame,
    path: str,
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write (page_id, url, html) as WARC files under ``path``."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body"))
    large = F.length("body") >= revisit_bytes
    firsts = rows.where(large).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = rows.join(firsts, "sha1", "left").select("page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def written(rows: Iterator[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for page_id, url, payload, first in rows:
            name = "" if page_id is None else page_id
            refers_to = None if first is None else f"urn:pages:{first}"
            # The suffix tells records of repeated ids apart.
            for made in records_of(f"urn:pages:{name}#{part}-{uuid.uuid4().hex}", url, payload, refers_to, segment_bytes):
                yield (made,)

    texts = map_rows(marked, written, "value binary").select(F.col("value").cast("string").alias("value"))
    texts.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is shorter than it says")
        yield headers, archive[start:stop]
        at = stop + 4


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = [x.lower().replace(b" ", b"") for x in head.split(CRLF)]
    return unchunked(body) if b"transfer-encoding:chunked" in lines else body


RAW = "record_type string, record_id string, target_uri string, refers_to string, digest string, origin string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records and segments of the archives under ``path``, one row each, blocks as they stand."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")

    def rows(archives: Iterator[tuple]) -> Iterator[tuple]:
        for (content,) in archives:
            for h, block in parsed(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                name, refers_to, origin = (h.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to", "warc-segment-origin-id"))
                segment, total = (int(h[k]) if k in h else None for k in ("warc-segment-number", "warc-segment-total-length"))
                origin = origin or (name if segment else None)
                yield h["warc-type"], name, h.get("warc-target-uri"), refers_to, h.get("warc-payload-digest"), origin, segment, total, block

    return map_rows(files, rows, RAW)


READ = "record_type string, record_id string, target_uri string, refers_to string, digest string, payload binary, problem string"


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records with decoded payloads: segments are grouped by origin, ordered, joined and verified."""
    single = records.where(F.col("origin").isNull()).select(
        "record_type", "record_id", "target_uri", "refers_to", "digest",
        F.array(F.struct(F.lit(1).alias("segment"), F.length("block").cast("long").alias("total"), "block")).alias("segments"),
    )
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = (
        records.where(F.col("origin").isNotNull())
        .groupBy("origin")
        .agg(first("record_type"), first("target_uri"), first("refers_to"), first("digest"), F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("segments"))
        .withColumnRenamed("origin", "record_id")
    )

    def whole(rows: Iterator[tuple]) -> Iterator[tuple]:
        for kind, name, uri, refers_to, digest, segments in rows:
            payload, problem = None, None
            block = b"".join(s["block"] for s in segments)
            if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                problem = "segments are missing or repeat"
            elif segments[-1]["total"] != len(block):
                problem = "the total length differs"
            elif kind == "response":
                try:
                    payload = decoded(block)
                except ValueError as error:
                    problem = str(error)
                if payload is not None and digest is not None and digest != f"sha1:{bare_digest(payload)}":
                    payload, problem = None, "the payload digest differs"
            yield kind, name, uri, refers_to, digest, payload, problem

    columns = ["record_type", "record_id", "target_uri", "refers_to", "digest", "segments"]
    return map_rows(single.unionByName(joined.select(columns)).select(columns), whole, READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return reassembled(read_records(spark, path))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    id_of = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:pages:([-0-9]*)', 1) AS bigint)")
    records = read_archives(spark, path).select(
        id_of("record_id").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        id_of("refers_to").alias("refers_to"),
    )
    records = stored(records, "warc-records")  # the archives are read once, for responses and revisits
    responses = records.where("record_type = 'response'")
    lengths = responses.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("same")).agg(F.max("payload_bytes").alias("full"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    resolved = revisits.join(lengths, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left")
    return responses.unionByName(resolved.withColumnRenamed("full", "payload_bytes").drop("of", "same"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - (i % 4) * 5)) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
