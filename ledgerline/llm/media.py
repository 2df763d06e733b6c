"""Media columns: signature sniffing, validation, carving, and text stored as audio samples.

An Aho-Corasick automaton finds the magic bytes of all known formats in one
pass.  A validator for the format then walks its structure and lengths, so a
magic that merely occurs in other data is dropped.  A column's declared type is
corrected to that of the valid file at its start, and valid files after it are
carved out.  Files inside a file are listed with the offset of the innermost file
around them.

A PDF runs to its last revision; the offset after startxref must lead to a table,
that of a later revision to one in the appended bytes.  An offset of 0 is taken where
no end of the file has a better one and the file isn't linearised.  An MP4 box of
size 0 runs to the end of the data; a known box that is cut short makes the file
invalid.

Cases: a null text is stored as one padded block; a null or unrecognised media
value has no detected type and nothing carved; repeated rows are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

BLOCK = 192
SAMPLE_RATE = 8000

# Signatures of public file formats, and where a file starts before its signature.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"RIFF": ("riff", 0),
    b"BM": ("bmp", 0),
    b"%PDF-": ("pdf", 0),
    b"OggS": ("ogg", 0),
    b"ftyp": ("mp4", 4),
}
MIME = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo", "bmp": "image/bmp", "pdf": "application/pdf", "ogg": "audio/ogg", "mp4": "video/mp4"}


def _png(d: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(d):
        (size,) = struct.unpack_from(">I", d, p)
        kind = d[p + 4 : p + 8]
        if first and (kind != b"IHDR" or size != 13) or p + 12 + size > len(d):
            return None
        if zlib.crc32(d[p + 4 : p + 8 + size]) != struct.unpack_from(">I", d, p + 8 + size)[0]:
            return None
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return "png", p - at
    return None


def _jpeg(d: bytes, at: int) -> tuple[str, int] | None:
    p = at + 2
    while p + 2 <= len(d) and d[p] == 0xFF:
        marker = d[p + 1]
        if marker == 0xFF:  # a fill byte
            p += 1
            continue
        if marker == 0xD9:
            return "jpeg", p + 2 - at
        if p + 4 > len(d):
            return None
        size = struct.unpack_from(">H", d, p + 2)[0]
        if marker < 0xC0 or size < 2:
            return None
        p += 2 + size
        if marker == 0xDA:  # entropy-coded data runs to the next marker that is neither stuffed nor a restart
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return None
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                elif d[p + 1] == 0xFF:
                    p += 1
                else:
                    break
    return None


def _gif(d: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(d):
        return None
    p = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)
    images = 0
    while p < len(d):
        kind = d[p]
        if kind == 0x3B:
            return ("gif", p + 1 - at) if images else None
        if kind == 0x2C and p + 10 <= len(d):
            p += 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 0x80 else 0)
            images += 1
        elif kind == 0x21:
            p += 2
        else:
            return None
        while p < len(d) and d[p]:
            p += 1 + d[p]
        p += 1
    return None


def _riff(d: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    kind = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(form)
    end = at + 8 + size
    if not kind or end > len(d):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, part = struct.unpack_from("<4sI", d, p)
        if p + 8 + part > end:
            return None
        seen.add(name)
        p += 8 + part + part % 2
    need = {"wav": {b"fmt ", b"data"}, "webp": set(), "avi": {b"LIST"}}[kind]
    return (kind, size + 8) if seen and need <= seen and p >= end else None


def _bmp(d: bytes, at: int) -> tuple[str, int] | None:
    if at + 54 > len(d):
        return None
    size, zero, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    pixels = -(-width * bits // 32) * 4 * abs(height)
    sound = zero == 0 and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return ("bmp", size) if sound and start >= 14 + head and start + pixels <= size and at + size <= len(d) else None


_PDF_END = re.compile(rb"startxref\s+(\d{1,18})\s+%%EOF")
_XREF = re.compile(rb"xref\b|\d+\s+\d+\s+obj\b")
_LINEAR = re.compile(rb"/Linearized\b[^>]*?/L\s+(\d{1,18})")


def _pdf(d: bytes, at: int) -> tuple[str, int] | None:
    if d[at + 5 : at + 7] not in (b"1.", b"2."):
        return None
    linear = _LINEAR.search(d, at, at + 1024)
    whole = at + int(linear[1]) if linear else 0
    end = bare = 0
    for found in _PDF_END.finditer(d, at):
        table = at + int(found[1])
        if int(found[1]) == 0:
            bare = bare or found.end()
        elif table < found.start() and _XREF.match(d, table) and (not end or table >= end or found.end() <= whole):
            end = found.end()
        elif linear and found.end() <= whole and table < whole and _XREF.match(d, table):
            end = max(end, found.end())  # the first part of a linearised file may name the table at its end
    if linear:  # line ends may follow the last mark
        return ("pdf", end - at) if end and end + 2 >= whole else None
    end = end or bare
    return ("pdf", end - at) if end else None


def _ogg_table() -> list[int]:
    """The remainders of a byte on top of a 32-bit word."""
    table = []
    for byte in range(256):
        word = byte << 24
        for _ in range(8):
            word = (word << 1 ^ (0x04C11DB7 if word & 1 << 31 else 0)) & 0xFFFFFFFF  # fixed value: the format's polynomial
        table.append(word)
    return table


_OGG_TABLE = _ogg_table()


def _ogg_checksum(page: bytes) -> int:
    word = 0
    for byte in page[:22] + bytes(4) + page[26:]:
        word = (word << 8 & 0xFFFFFFFF) ^ _OGG_TABLE[word >> 24 ^ byte]
    return word


def _ogg(d: bytes, at: int) -> tuple[str, int] | None:
    """Pages of one or more streams, side by side or one after the other; the file ends where all that began have ended."""
    p, end, running = at, at, set()
    while d.startswith(b"OggS\0", p) and p + 27 <= len(d):
        flags, serial, said, n = d[p + 5], *struct.unpack_from("<I", d, p + 14), *struct.unpack_from("<I", d, p + 22), d[p + 26]
        if p + 27 + n > len(d):
            break
        stop = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        begins = bool(flags & 2)
        if stop > len(d) or begins == (serial in running) or _ogg_checksum(d[p:stop]) != said:
            break
        running.add(serial)
        if flags & 4:
            running.discard(serial)
        p = stop
        if not running:
            end = p
    return ("ogg", end - at) if end > at else None


#: Boxes at the top of an MP4 file: after one of these names the size must hold.
_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"ssix", b"styp", b"meta", b"uuid", b"pdin", b"prft", b"emsg"}


def _mp4(d: bytes, at: int) -> tuple[str, int] | None:
    if at < 0:
        return None
    p, seen = at, set()
    while p + 8 <= len(d):
        size, name = struct.unpack_from(">I4s", d, p)
        if name not in _BOXES and not (size >= 8 and p + size <= len(d) and name.isalnum()) or name == b"ftyp" and p > at:
            break
        least = 8
        if size == 1:
            if p + 16 > len(d):
                return None
            least, size = 16, struct.unpack_from(">Q", d, p + 8)[0]
        elif size == 0:
            size = len(d) - p
        if size < least or p + size > len(d):
            return None
        seen.add(name)
        p += size
    return ("mp4", p - at) if {b"ftyp", b"moov"} <= seen else None


VALIDATORS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {"png": _png, "jpeg": _jpeg, "gif": _gif, "riff": _riff, "bmp": _bmp, "pdf": _pdf, "ogg": _ogg, "mp4": _mp4}

_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        tool = ahocorasick.Automaton()
        for magic, (kind, back) in SIGNATURES.items():
            tool.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
        tool.make_automaton()
        _AUTOMATON.append(tool)
    return _AUTOMATON[0]


def sniff_nested(data: bytes) -> list[tuple[int, int, str, int | None]]:
    """(offset, length, type, offset of the innermost file around it or None) of the valid files in ``data``."""
    found: list[tuple[int, int, str, int | None]] = []
    hits = sorted((end - back, kind) for end, (back, kind) in _automaton().iter(data.decode("latin-1")))
    around: list[tuple[int, int]] = []
    for at, kind in hits:
        if at < 0 or not (hit := VALIDATORS[kind](data, at)):
            continue
        end = at + hit[1]
        while around and at >= around[-1][1]:
            around.pop()
        if around and end > around[-1][1]:
            continue  # neither inside nor after the file around it
        found.append((at, hit[1], hit[0], around[-1][0] if around else None))
        around.append((at, end))
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid files in ``data``; a file inside another one is not listed."""
    return [x[:3] for x in sniff_nested(data) if x[3] is None]


_SNIFFED = "detected_type string, corrected boolean, carved array<struct<offset:long,length:long,type:string>>, nested array<struct<offset:long,length:long,type:string,parent:long>>"


def sniff_column(df: DataFrame, media: str, declared: str) -> DataFrame:
    """Add detected_type, corrected (it differs from the declared one), carved (files that start later) and nested (files inside those).

    Columns of these names that are there already are replaced.
    """

    @F.pandas_udf(f"struct<{_SNIFFED.replace(' ', ':', 1).replace(', corrected ', ',corrected:').replace(', carved ', ',carved:').replace(', nested ', ',nested:')}>")
    def udf(values, said):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for value, claim in zip(values, said, strict=True):
            every = sniff_nested(bytes(value)) if value is not None else []
            files = [x[:3] for x in every if x[3] is None]
            whole = MIME[files[0][2]] if files and files[0][0] == 0 else None
            rows.append((whole, whole is not None and whole != claim, [{"offset": o, "length": n, "type": MIME[k]} for o, n, k in files if o], [{"offset": o, "length": n, "type": MIME[k], "parent": p} for o, n, k, p in every if p is not None]))
        return pd.DataFrame(rows, columns=["detected_type", "corrected", "carved", "nested"])

    df = df.drop("detected_type", "corrected", "carved", "nested")
    return df.withColumn("_sniffed", udf(F.col(media), F.col(declared))).select(*[F.col(c) for c in df.columns], "_sniffed.detected_type", "_sniffed.corrected", "_sniffed.carved", "_sniffed.nested")


def wav_of(payload: bytes) -> bytes:
    """The bytes as 8-bit mono PCM samples; the payload has an even length."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(wav: bytes) -> bytes:
    p = 12
    while p + 8 <= len(wav):
        name, size = struct.unpack_from("<4sI", wav, p)
        if name == b"data":
            return wav[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no samples")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared_type and the padded text as a WAV file in ``media``."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            media = [wav_of(x.ljust(max(BLOCK, -(-len(x) // BLOCK) * BLOCK), b" ")) for x in raw]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "declared_type": pa.array(["application/octet-stream"] * len(raw)), "media": pa.array(media, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(stored, "doc_id long, n_bytes long, declared_type string, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected_type string, n_carved int, corrected boolean"


def media_features(media: DataFrame) -> DataFrame:
    """Sniff the stored bytes, take the samples out of the valid file and describe them; n_carved counts the files in the payload, too."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data, claim in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = data.as_py()
                files = sniff_nested(data)
                kind = files[0][2] if files and files[0][0] == 0 else None
                payload = samples_of(data[: files[0][1]]) if kind == "wav" else data
                x = np.frombuffer(payload, np.uint8)
                wide = x.astype(np.int64) - 128
                feature = f"{kind};n={len(x)};sum={int(wide.sum())};energy={int((wide * wide).sum())};turns={int(np.count_nonzero(np.diff(x >= 128)))};steps={int(np.abs(np.diff(wide)).sum())};low={int(x.min())};high={int(x.max())}"
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, MIME.get(kind), len(files) - (kind is not None), kind is not None and MIME[kind] != claim))
            if rows:
                names = [c.split()[0] for c in _FEATURES.split(", ")]
                kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in _FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media", "declared_type").mapInArrow(features, _FEATURES)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(stage(store_texts(table(spark, sf_dir, "documents")), "media"))
