"""Legacy web archives: ARC files are parsed and converted to equivalent WARC records.

An ARC file opens with a version block that says which fields the header lines
of its records have (version 1: five, version 2: ten); a record is its header
line and as many bytes as the line declares. The converter gives each record
what ARC does not know: an identifier, an ISO time, a type, digests; records
whose payload another record already has become revisits of it.

Files are written by Spark's text writer into a shared folder, gzip-compressed,
one archive per partition, and read as whole files whose records are streamed:
a task holds one compressed archive and a few records at a time.

Defined cases: null html is an empty payload, a null url or key is ``-`` in the
archive and null when read; white space in urls is percent-encoded in header
lines; payloads below ``REVISIT_BYTES`` and payloads that occur once are
responses; of equal larger payloads the largest key is the response (rows that
share this key all are, and if no row of the group has a key, all are);
dates that do not parse become 1970-01-01T00:00:00Z; a truncated last record
fails the job; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans import fresh_dir, stage
from ..plans.skew import BROADCAST_ROWS
from .common import table

REVISIT_BYTES = 1000
#: Bytes of records that a task gathers before it hands them on.
BATCH_BYTES = 4 << 20

ARC_FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
_FIELD_LINE = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


# ARC


def arc_opening(version: int, name: str, date: str = "19700101000000") -> str:
    """The version block of an ARC file, without the newline after it."""
    body = f"{version} 0 spark\n{_FIELD_LINE[version]}\n"
    first = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    return first + ("200 - - 0 - " if version == 2 else "") + f"{len(body)}\n{body}"


def arc_records(file: BinaryIO) -> Iterator[dict]:
    """Fields of each record of an ARC file, with its ``block`` of bytes; the version block is not among them."""
    fields: list[str] | None = None
    while line := file.readline():
        if not line.strip():
            continue
        line = line.rstrip(b"\r\n")
        if fields is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError(f"no ARC version block: {line[:60]!r}")
            block = _exactly(file, int(line.split(b" ")[-1]))
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = ARC_FIELDS[version]
            continue
        # Old writers left blanks in urls: the other fields are taken from the right.
        parts = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields):
            raise ValueError(f"bad ARC header line: {line[:200]!r}")
        record = dict(zip(fields, parts))
        record["block"] = _exactly(file, int(record.pop("length")))
        yield record


def _exactly(file: BinaryIO, size: int) -> bytes:
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"archive ends {size - len(data)} bytes too early")
    return data


def arc_line(url: Column, key: Column, date: Column, mime: str, block: Column, version: int) -> Column:
    """A record as text: header line and block. Only version 2 has a field for the key."""
    address = F.coalesce(F.nullif(F.regexp_replace(url, r"[\x00-\x20]", "%20"), F.lit("")), F.lit("-"))
    middle = [F.lit("200"), F.lit("-"), F.coalesce(key.cast("string"), F.lit("-")), F.lit("0"), F.lit("-")]
    head = [address, F.lit("0.0.0.0"), date, F.lit(mime), *(middle if version == 2 else []), F.octet_length(block)]
    return F.concat(F.concat_ws(" ", *[h.cast("string") for h in head]), F.lit("\n"), block)


def write_arc(pages: DataFrame, path: str, version: int = 2, date: Column | None = None) -> None:
    """Pages ``(page_id, url, html)`` as ARC files: HTTP responses with the html as their payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    lines = pages.select(
        arc_line(F.col("url"), F.col("page_id"), date or F.lit("19700101000000"), "text/html", F.concat(head, html), version).alias("value")
    )
    opening = arc_opening(version, "pages.arc")

    def with_opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([opening])], schema=schema)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], schema=schema)

    lines.mapInArrow(with_opening, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


# WARC


def record_id(url: str | None, key: str | None, digest: str) -> str:
    """A URN that is the same whenever the record is converted again."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url or ""}\n{key or ""}\n{digest}')}>"


def iso_time(date: str | None) -> str:
    """ARC's digits (as few as a year) as ISO time."""
    digits = date if date and re.fullmatch(r"\d{4,14}", date) else ""
    try:
        return datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """HTTP head (with the blank line) and payload; None if the block is no HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def warc_record(record: dict, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record; with ``refers_to`` (the key of the response) a revisit.

    Without the two line ends that follow a record in a file.
    """
    url, key = (None if record.get(k) in (None, "-") else record[k] for k in ("url", "location"))
    parts = split_http(record["block"])
    head, payload = parts or (b"", record["block"])
    digest = sha1(payload)
    kind = "revisit" if refers_to is not None else "response" if parts else "resource"
    block = head if kind == "revisit" else record["block"]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(url, key, digest)),
        ("WARC-Date", iso_time(record.get("date"))),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", record.get("ip")),
        ("Content-Type", "application/http; msgtype=response" if parts else record.get("mime")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Archive-Key", key),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields[3:3] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("Archive-Refers-To-Key", refers_to),
        ]
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block


def warc_records(file: BinaryIO) -> Iterator[dict]:
    """Header fields (lower case) of each record of a WARC file, with its ``block``."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        record: dict = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            record[name.strip().lower()] = value.strip()
        record["block"] = _exactly(file, int(record["content-length"]))
        yield record


# Spark


def _read(spark: SparkSession, path: str, schema: str, rows: Callable[[BinaryIO], Iterator[tuple]]) -> DataFrame:
    """Rows of all archives below a folder; each archive is streamed."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

        for batch in batches:
            for content in batch.column(0):
                found, size = [], 0
                for row in rows(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    found.append(row)
                    size += 200 + sum(len(v) for v in row if isinstance(v, bytes))
                    if size > BATCH_BYTES:
                        yield batch_of(found)
                        found, size = [], 0
                if found:
                    yield batch_of(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, out)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """``(url, key, date, ip, mime, block)`` of the records of ARC files."""

    def rows(file):
        for r in arc_records(file):
            yield (*(None if r.get(k) in (None, "-") else r[k] for k in ("url", "location", "date", "ip", "mime")), r["block"])

    return _read(spark, path, "url string, key string, date string, ip string, mime string, block binary", rows)


def revisits(spark: SparkSession, arc_path: str, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``(key, refers_to)`` of the ARC records whose payload a record with a larger key has."""

    def rows(file):
        for r in arc_records(file):
            payload = (split_http(r["block"]) or (b"", r["block"]))[1]
            if len(payload) >= least_bytes and (r.get("location") or "-") != "-":
                yield int(r["location"]), hashlib.sha1(payload).digest()

    digests = stage(_read(spark, arc_path, "key long, digest binary", rows))
    groups = digests.groupBy("digest").agg(F.max("key").alias("refers_to"), F.min("key").alias("_least"))
    groups = groups.where(F.col("_least") < F.col("refers_to")).drop("_least")
    # Few digests repeat; hot ones are split by adaptive execution, as the groups have one row each.
    found = digests.join(groups, "digest").where(F.col("key") < F.col("refers_to"))
    return stage(found.select("key", "refers_to").distinct())


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = REVISIT_BYTES) -> None:
    """Write the WARC files of all ARC files below a folder."""
    again = revisits(spark, arc_path, least_bytes)
    records = read_arc(spark, arc_path)
    # Payloads are moved only where there are too many revisits to be sent to all tasks.
    sized = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    marked = records.join(sized.select(F.col("key").cast("string").alias("key"), "refers_to"), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.to_pylist():
                refers_to = r.pop("refers_to")
                r["location"] = r.pop("key")
                texts.append(warc_record(r, None if refers_to is None else str(refers_to)))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["value"])

    lines = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)


def read_warc(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """Records of WARC files: ``(record_id, record_type, date, url, key, refers_to, payload_bytes, payload_digest)``, ``block`` if asked for.

    Length and digest are those of the full payload, also for revisits, which do not hold it.
    """

    def rows(file):
        for r in warc_records(file):
            head, payload = split_http(r["block"]) or (b"", r["block"])
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if r["warc-type"] == "revisit":
                size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
                digest = base64.b32decode(r["warc-payload-digest"].partition(":")[2]).hex()
            found = [r["warc-record-id"], r["warc-type"], r["warc-date"], r.get("warc-target-uri"), r.get("archive-key"), r.get("archive-refers-to-key")]
            yield (*found, size, digest, *([r["block"]] if blocks else []))

    names = ["record_id", "record_type", "date", "url", "key", "refers_to"]
    schema = ", ".join(f"{n} string" for n in names) + ", payload_bytes long, payload_digest string" + ", block binary" * blocks
    return _read(spark, path, schema, rows)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = fresh_dir(spark, "arc"), fresh_dir(spark, "warc")
    write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < last THEN last END AS refers_to
FROM m"""
