"""WARC archives: a writer with revisit records and a salvage reader.

The writer makes one gzip member a record.  Spark's text sink stores the bytes,
so archives go to any store that Spark writes to: every member ends with a zero
byte (the top byte of its length), which the sink adds as its line separator.

The reader checks each record (gzip checksum, version line, lengths, closing
line, block and payload digest).  After a failed check it searches for the next
gzip member or version line that passes all of them, goes on from there, and
reports the bytes between as a quarantined gap with the reason.

Cases: a null html is an empty payload; a null url is left out; a null page_id
stays null and never is the target of a revisit; rows that repeat a page_id and
its payload are all of the same type; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, new_path, stage, table, unstage

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
RECORD_ID = "<urn:ledgerline:page:{}>"

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 28
#: What one record may inflate to; Spark holds no larger value.
MOST_RECORD = (1 << 31) - 1
DATE = "2000-01-01T00:00:00Z"

_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_STEP = 1 << 14


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """An uncompressed record; a revisit has the HTTP header but not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    known = lambda x: "" if x is None else x
    lines = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {RECORD_ID.format(known(page_id))}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {RECORD_ID.format(known(refers_to))}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    """A member whose last byte is zero; a record of 16 MB or more gets an empty member after it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    if member[-1]:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member += packer.flush()
    return member


@dataclass
class Record:
    offset: int
    length: int
    type: str
    record_id: str
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int | None
    payload_digest: str | None


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class _Bad(Exception):
    pass


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    tool, out, fed, held = zlib.decompressobj(31), [], at, 0
    try:
        while not tool.eof:
            if fed >= len(data):
                raise _Bad("gzip member cut short")
            out.append(tool.decompress(data[fed : fed + _STEP]))
            fed += _STEP
            held += len(out[-1])
            if held > MOST_RECORD:
                raise _Bad("record larger than a value may be")
    except zlib.error as e:
        raise _Bad(f"gzip: {e}") from None
    return b"".join(out), min(fed, len(data)) - len(tool.unused_data)


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the uncompressed record at ``at``."""
    if not _VERSION_LINE.match(data, at):
        raise _Bad("no version line")
    # No header has a version line inside: the search ends at the next one, and all searches together are one pass.
    following = _VERSION_LINE.search(data, at + len(VERSION))
    stop = data.find(b"\r\n\r\n", at, following.start() if following else len(data))
    if stop < 0:
        raise _Bad("header without end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise _Bad("header line without colon")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdecimal():
        raise _Bad("no content length")
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Bad("length leads past the closing line")
    return headers, data[begin:end], end + 4


def _checked(headers: dict[str, str], block: bytes, offset: int, length: int) -> Record:
    if (said := headers.get("warc-block-digest")) and said.startswith("sha1:") and said[5:] != base32_sha1(block):
        raise _Bad("block digest differs")
    if not all(headers.get(h) for h in ("warc-type", "warc-record-id", "warc-date")):
        raise _Bad("a mandatory header is missing")
    kind = headers["warc-type"]
    payload, digest, size = None, None, None
    if "application/http" in headers.get("content-type", ""):
        head, ended, body = block.partition(b"\r\n\r\n")
        if not ended:
            raise _Bad("HTTP header without end")
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "revisit":
            found = re.search(rb"(?im)^content-length: *(\d+)\r?$", head)
            size = int(found[1]) if found else None
        else:
            payload, size = body, len(body)
            if digest and digest != base32_sha1(body):
                raise _Bad("payload digest differs")
    return Record(offset, length, kind, headers.get("warc-record-id", ""), headers, payload, size, digest)


def _read_at(data: bytes, at: int) -> tuple[Record | None, int]:
    """The record at ``at`` (None for an empty member) and where the next one starts."""
    if data.startswith(GZIP_MAGIC, at):
        inner, end = _inflate(data, at)
        if not inner:
            return None, end
        headers, block, stop = _plain(inner, 0)
        if stop != len(inner):
            raise _Bad("more than a record in a member")
        return _checked(headers, block, at, end - at), end
    headers, block, end = _plain(data, at)
    return _checked(headers, block, at, end - at), end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that pass the checks, and the gaps between them."""
    at, bad_from, why = 0, None, ""
    while at < len(data):
        try:
            record, end = _read_at(data, at)
        except _Bad as e:
            if bad_from is None:
                bad_from, why = at, str(e)
            found = _CANDIDATE.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad_from is not None:
            yield Gap(bad_from, at - bad_from, why)
            bad_from = None
        if record:
            yield record
        at = end
    if bad_from is not None:
        yield Gap(bad_from, len(data) - bad_from, why)


def write_archives(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write a record a page; of equal payloads of ``min_bytes`` or more only the smallest page_id is stored."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    # SHA-1 names a payload, but texts with equal ones can be made; SHA-256 and the length decide.
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    groups = stage(groups, "warc-groups")
    marked = attach_by_key(rows, groups, ["digest", "size"], "copies", max(1, pages.count()), F.col("page_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    marked = marked.select("page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = held = 0
        for batch in batches:
            made, archives = [], []
            for i, u, p, r, v in zip(*batch.columns, strict=True):
                made.append(gzip_member(make_record(i.as_py(), u.as_py(), p.as_py(), r.as_py(), v.as_py()))[:-1])
                archives.append(archive)
                held += len(made[-1])
                if held >= ARCHIVE_BYTES:
                    archive, held = archive + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.large_binary()).cast(pa.binary()), pa.array(archives, pa.int32())], names=["member", "archive"])

    path = new_path(spark, "warc")
    stored = marked.mapInArrow(members, "member binary, archive int").select(F.col("member").cast("string").alias("value"), "archive")
    stored.write.option("lineSep", "\0").partitionBy("archive").text(path)
    unstage(groups)
    return path


_READ_SCHEMA = "archive string, offset long, length long, record_type string, record_id string, page_id long, refers_to long, target_uri string, payload binary, payload_bytes long, payload_digest string, gap_reason string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record and, with gap_reason, for each quarantined gap."""

    def number(text: str | None) -> int | None:
        found = re.search(r":page:(-?\d+)>$", text or "")
        return int(found[1]) if found else None

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _READ_SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in _READ_SCHEMA.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        rows.append((archive, x.offset, x.length, *[None] * 8, x.reason))
                    else:
                        held += len(x.payload or b"")
                        rows.append((archive, x.offset, x.length, x.type, x.record_id, number(x.record_id), number(x.headers.get("warc-refers-to")), x.headers.get("warc-target-uri"), x.payload if payloads else None, x.payload_bytes, x.payload_digest, None))
                    if len(rows) >= 1000 or held > 1 << 25:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(records, _READ_SCHEMA)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"))
    found = read_archives(spark, path, payloads=False).where(F.col("gap_reason").isNull())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
