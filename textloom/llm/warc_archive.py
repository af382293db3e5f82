"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds each distinct payload once as a
zstd frame, keyed by the SHA-256 of the payload, and ``headers`` holds each record's exact header bytes
with that key. Records are rebuilt by a join. Digests are verified: on writing,
payloads of one key must agree in length and in a second, unlike hash; on
reading, each stored payload is hashed again. Of the records with equal
payloads that with the largest page id is the response and the others are
revisits that refer to it; payloads smaller than ``min_bytes`` are all responses.

Defined results: a null html is an empty payload; a null url leaves out the
target header; every record has the date ``date``, as pages have none; control characters in urls are percent-encoded; null page ids go
below all others and are written as an empty id; rows that share the largest id
are all responses; an empty table gives an empty archive; further columns are
ignored. The join from pages to keys has one row per key on its right, so
adaptive skew handling may split a payload that a third of all pages share.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import CLEANUP, erase, new_path, settings, written

#: WARC/1.1 names.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:textloom:page:"
CRLF = "\r\n"
#: Pages come without a time of capture; archives of equal pages are equal.
DATE = "1970-01-01T00:00:00Z"


def _keyed(id_type: str):
    """(page_id, url, html) to rows with the payload's digests, length, and a second hash."""

    def run(batches):
        for batch in batches:
            payloads = [x or b"" for x in batch.column(2).to_pylist()]
            columns = [
                pa.array([hashlib.sha256(x).digest() for x in payloads], pa.binary()),
                pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in payloads], pa.string()),
                pa.array([len(x) for x in payloads], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(x) >> 1 for x in payloads], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "key", "sha1", "n", "second"])

    return run, f"page_id {id_type}, url string, key binary, sha1 string, n long, second long"


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(pack, batch.column(2).to_pylist()), pa.binary())], names=["page_id", "of", "frame"])


def _unpacked(batches):
    """(header, key, frame) to (header, payload, sha1, record), with the payload verified against its key; sha1 is computed from the payload read."""
    for batch in batches:
        payloads, digests, records = [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for header, key, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            payload = unpack(frame)
            if hashlib.sha256(payload).digest() != key:
                raise ValueError("a stored payload does not have its digest")
            payloads.append(payload)
            digests.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
            block = b"" if b"\r\nWARC-Type: revisit\r\n" in header else payload
            records.append(header + block + CRLF.encode() * 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payloads, pa.binary()), pa.array(digests, pa.string()), pa.array(records, pa.binary())], names=["header", "payload", "sha1", "record"])


def record_header(page_id: Column, url: Column, revisit: Column, refers_to: Column, digest: Column, length: Column, date: str) -> Column:
    """The header block; the record's own block is the payload, or nothing for a revisit."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    name = lambda i: F.concat(F.lit(f"<{RECORD_URN}"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    safe = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    safe = F.when(url.rlike(r"[\r\n]"), safe).otherwise(url)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(page_id)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name(refers_to)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(length).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``payloads`` and ``headers`` below ``path``. Payloads are moved as the frames that are kept."""
    run, fields = _keyed(pages.schema[id_col].dataType.simpleString())
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = written(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).mapInArrow(run, fields), "warc-rows")
    check = F.struct("n", "second")
    keys = rows.groupBy("key").agg(F.max("page_id").alias("top"), F.min(check).alias("c"), F.max(check).alias("d"))
    keys = keys.select("key", F.when(F.col("c") == F.col("d"), F.struct("top")).otherwise(F.raise_error(F.lit("unlike payloads share a SHA-256 digest")).cast(keys.select(F.struct("top")).dtypes[0][1])).alias("t"))
    keys = written(keys.select("key", "t.top"), "warc-keys")
    first = F.col("page_id").eqNullSafe(F.col("top"))
    # By page as well as by payload, so that a payload that many pages have is dealt over all tasks.
    whole = pages.select(F.col(id_col).alias("page_id"), F.unhex(F.sha2(html, 256)).alias("of"), html.alias("html"))
    whole = whole.mapInArrow(_packed, f"page_id {pages.schema[id_col].dataType.simpleString()}, of binary, frame binary")
    whole = whole.join(keys, (F.col("of") == F.col("key")) & first).dropDuplicates(["key"]).select("key", "frame")
    with settings(pages.sparkSession, CLEANUP):
        whole.write.parquet(f"{path}/payloads", compression="none")
        told = rows.join(keys, "key")
        header = record_header(F.col("page_id"), F.col("url"), ~first & (F.col("n") >= min_bytes), F.col("top"), F.col("sha1"), F.col("n"), date)
        told.select("key", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers", compression="zstd")
    for done in (rows, keys):
        erase(done)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, sha1, record): the full payload of each record, its digest (bare base32), and the record's exact bytes."""
    stored = spark.read.schema("key binary, frame binary").parquet(f"{path}/payloads")
    headers = spark.read.schema("key binary, header binary").parquet(f"{path}/headers")
    return headers.join(stored, "key").select("header", "key", "frame").mapInArrow(_unpacked, "header binary, payload binary, sha1 string, record binary")


def header_field(header: Column, name: str) -> Column:
    """Null where the header lacks the field."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def digest_archive(records: DataFrame) -> DataFrame:
    """One row per record, from what was read back; the digest is that of the payload read, and an error if the header says another."""
    page = lambda field: F.regexp_extract(header_field(F.col("header"), field), rf"^<{RECORD_URN}(-?\d*)>$", 1)
    kind = header_field(F.col("header"), "WARC-Type")
    number = lambda x: F.when(x != "", x.cast("long"))
    return records.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(header_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("a header does not have its payload's digest")).cast("string")).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", number(page("WARC-Refers-To"))).alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and return its records as read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(spark, path)
