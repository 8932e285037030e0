"""WARC archives with revisit resolution.

Headers (page, digest, size) are shuffled by payload digest without payloads; the smallest page of each
digest is its original, the others become revisit records that refer to it. Archives are gzipped text files whose
records end in two line breaks, which is what Spark's text writer puts between rows; they are read back by
their Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, staged

LEAST_BYTES = 100
FILE_BYTES = 32 << 20  # payload of an archive file, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_headers(pages: DataFrame) -> DataFrame:
    """``pages`` with ``payload`` (the html, null: empty), its ``bytes`` and its SHA-256 ``digest``."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    return p.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.encode("payload", "UTF-8"), 256)})


def resolve_revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, digest, original, original_url`` of the records that revisit another: of those with an equal
    digest and at least ``least`` bytes all but those of the smallest page_id. A null page_id is never an
    original and never revisits."""
    big = headers.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    first = big.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("o"), F.max("page_id").alias("last")).filter("o.page_id < last")
    rest = big.join(first, "digest").filter("page_id > o.page_id")
    return rest.select("page_id", "url", "digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url")).distinct()


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"), F.substring(h, a, n)) if a > 1 else (F.substring(h, a, n),))), F.lit(">"))


def _dealt(rows: DataFrame, files: int) -> DataFrame:
    return rows.withColumn("target", F.coalesce("url", F.lit(""))).repartition(files, "page_id", "digest", "target")


def warc_records(pages: DataFrame, files: int, least: int = LEAST_BYTES, date: str | None = None) -> DataFrame:
    """One ``value`` per row of ``pages``: a whole record without the two line breaks at its end, dealt to ``files``
    partitions; the first one of each has a warcinfo record in front. Payloads are shuffled once: the revisits are
    dealt alike, by page, digest and url, and joined there. Line breaks in a url become %0D and %0A; ``date`` is
    that of the run unless it is given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    all_ = payload_headers(pages)
    seen = staged(resolve_revisits(all_.select("page_id", "url", "bytes", "digest"), least), "revisits")
    p = _dealt(all_, files).join(_dealt(seen, files).drop("url").hint("merge"), ["page_id", "digest", "target"], "left")

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")

    def clean(url: Column) -> Column:
        return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    again = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Page-Id", F.col("page_id")), line("WARC-Profile", F.when(again, PROFILE)), line("WARC-Refers-To", F.when(again, _record_id(F.col("original"), F.col("digest")))),
        line("WARC-Refers-To-Target-URI", F.when(again, clean(F.col("original_url")))), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size), F.lit("\r\n"))
    place = F.monotonically_increasing_id()
    about = "software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    info = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: "), _record_id(F.spark_partition_id(), F.lit(uuid.uuid4().hex)),
                    F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n"))
    start = F.when(place.bitwiseAND(F.lit((1 << 33) - 1)) == 0, info).otherwise("")
    return p.select(F.concat(start, head, http, F.when(again, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row of ``pages`` to files of about ``file_bytes``; an empty table writes no record."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    warc_records(pages, files, least).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _read(batches):
    """Records of whole files; a response's digest and size are taken from its payload, not from its header."""
    for b in batches:
        for data in b.column(0).to_pylist():
            at, rows, data = 0, [], gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                lines = data[at:end].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"no record at byte {at}")
                head = dict(x.split(": ", 1) for x in lines[1:])
                body = end + 4
                stop = body + int(head["Content-Length"])
                if head["WARC-Type"] == "warcinfo":
                    at = stop + 4
                    continue
                payload = data[data.index(b"\r\n\r\n", body, stop) + 4 : stop]
                page, again = head.get("X-Page-Id"), head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if not again and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload at byte {body} isn't what its header says")
                rows.append((page and int(page), head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), digest, None if again else len(payload), head.get("WARC-Target-URI")))
                at = stop + 4
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()), strict=True)],
                                                 names=["page_id", "record_type", "record_id", "refers_to_id", "payload_digest", "payload_bytes", "url"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records read from the files, revisits joined to the responses that they refer to for size and page."""
    raw = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    r = raw.mapInArrow(_read, "page_id long, record_type string, record_id string, refers_to_id string, payload_digest string, payload_bytes long, url string")
    first = r.filter("record_type = 'response'").groupBy(F.col("record_id").alias("first_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("n"), F.max("payload_digest").alias("d"))
    out = r.join(first, (F.col("refers_to_id") == F.col("first_id")) & (F.col("payload_digest") == F.col("d")), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Each page's record, read back from the archives."""
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).drop("url")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha256(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS o FROM q WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest, CASE WHEN o < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o < page_id THEN o END AS refers_to
FROM q LEFT JOIN f ON f.d = q.d AND q.n >= 100
"""
