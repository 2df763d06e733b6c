import hashlib
import struct
import zlib

import pytest

from ledgerline.llm import media

from .helpers import documents, empty, texts


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\x08\1\1\0\0?\0\x12\xff\0\x34\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n0\n%%EOF"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov")


def ogg_sum(data):
    word = 0
    for byte in data:
        for bit in range(7, -1, -1):
            top = word >> 31 ^ byte >> bit & 1
            word = (word << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return word


def page(flags, serial, body):
    head = b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<II", serial, 0)
    tail = bytes([1, len(body)]) + body
    return head + struct.pack("<I", ogg_sum(head + bytes(4) + tail)) + tail


OGG = page(2, 1, b"hello") + page(4, 1, b"end")
FILES = {"png": png(), "bmp": bmp(), "gif": GIF, "jpeg": JPEG, "pdf": PDF, "mp4": MP4, "ogg": OGG, "wav": media.wav_of(b"ab" * 96)}


@pytest.mark.parametrize("kind", FILES)
def test_formats(kind):
    data = FILES[kind]
    assert media.sniff(data) == [(0, len(data), kind)]
    assert media.sniff(b"BM RIFF text " + data + b" and more") == [(13, len(data), kind)]
    assert media.sniff(data[: len(data) - 1]) == []


def test_files_inside():
    data = b"..".join(FILES[k] for k in ("png", "gif", "wav"))
    assert [k for _, _, k in media.sniff(data)] == ["png", "gif", "wav"]
    assert media.sniff(media.wav_of(FILES["png"].ljust(192, b" ")))[0][2] == "wav"


def test_columns_are_corrected(spark):
    rows = [(1, FILES["png"] + FILES["gif"], "image/jpeg"), (2, FILES["wav"], "audio/wav"), (3, b"plain", "text/plain"), (4, None, None), (5, b"", "x")]
    df = spark.createDataFrame(rows, "id int, data binary, declared string").selectExpr("*", "'old' as carved")
    got = {r["id"]: r for r in media.sniff_column(df, "data", "declared").collect()}
    assert (got[1]["detected_type"], got[1]["corrected"]) == ("image/png", True)
    assert [tuple(c) for c in got[1]["carved"]] == [(len(FILES["png"]), len(GIF), "image/gif")]
    assert (got[2]["corrected"], got[3]["detected_type"], got[4]["carved"], got[5]["detected_type"]) == (False, None, [], None)


def pdf(body=b"1 0 obj\nendobj\n"):
    data = b"%PDF-1.4\n" + body
    return data + b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(data)


def test_pdf_runs_to_its_last_revision():
    one = pdf()
    two = one + b"\n2 0 obj\nendobj\n"
    two += b"xref\n2 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(two)
    assert media.sniff(b"-" + two + b" and more") == [(1, len(two), "pdf")]
    assert media.sniff(one + one) == [(0, len(one), "pdf"), (len(one), len(one), "pdf")]
    assert media.sniff(one.replace(b"startxref\n", b"startxref\n9")) == []
    head = b"%PDF-1.4\n1 0 obj\n<</Linearized 1/L 000200>>endobj\n"
    linear = head + b"xref\n0 1\ntrailer\nstartxref\n0\n%%EOF\n" + b"2 0 obj\nendobj\n"
    tail = b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(head)
    linear = linear.ljust(200 - len(tail)) + tail
    assert media.sniff(linear) == [(0, 200, "pdf")]
    assert media.sniff(linear[:150]) == []


def test_mp4_box_sizes():
    ftyp, moov = MP4[:16], MP4[16:]
    long_box = struct.pack(">I4sQ", 1, b"mdat", 16 + 50) + b"x" * 50
    to_end = struct.pack(">I4s", 0, b"mdat") + b"y" * 50
    for data in (ftyp + moov + long_box, ftyp + long_box + moov, ftyp + moov + to_end):
        assert media.sniff(data) == [(0, len(data), "mp4")]
    assert media.sniff((ftyp + moov + long_box)[:-1]) == []
    assert media.sniff(MP4 + MP4) == [(0, len(MP4), "mp4"), (len(MP4), len(MP4), "mp4")]


def test_nested_files_have_their_parent(spark):
    data = pdf(b"stream\n" + JPEG + b"\nendstream\n")
    at = data.index(JPEG)
    assert media.sniff_nested(data) == [(0, len(data), "pdf", None), (at, len(JPEG), "jpeg", 0)]
    row = media.sniff_column(spark.createDataFrame([(data, "x")], "data binary, declared string"), "data", "declared").first()
    assert (row["carved"], [tuple(x) for x in row["nested"]]) == ([], [(at, len(JPEG), "image/jpeg", 0)])
    stored = spark.createDataFrame([(1, 5, "application/octet-stream", media.wav_of(FILES["gif"].ljust(192))), (2, 5, "audio/wav", FILES["wav"])], "doc_id long, n_bytes long, declared_type string, media binary")
    got = {r["doc_id"]: (r["n_carved"], r["corrected"]) for r in media.media_features(stored).collect()}
    assert got == {1: (1, True), 2: (0, False)}


def test_stored_texts_come_back(spark):
    got = media.media_features(media.store_texts(documents(spark))).collect()
    want = {}
    for d, t in texts():
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        want.setdefault((d, len(raw)), (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert len(got) == len(texts())
    features = {}
    for r in got:
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[(r["doc_id"], r["n_bytes"])]
        assert r["detected_type"] == "audio/wav" and r["media_bytes"] == r["payload_bytes"] + 44
        assert features.setdefault(r["payload_sha256"], (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"])
    assert media.media_features(media.store_texts(empty(spark))).count() == 0


def test_ogg_streams():
    assert ogg_sum(b"123456789") == 0x89A1897F
    side = page(2, 1, b"a") + page(2, 2, b"b") + page(4, 2, b"c") + page(4, 1, b"d")
    assert media.sniff(side) == [(0, len(side), "ogg")]
    assert media.sniff(side + OGG + b"tail") == [(0, len(side + OGG), "ogg")]
    broken = bytearray(side)
    broken[-1] ^= 1
    assert media.sniff(bytes(broken)) == [(29, 58, "ogg")]  # the second stream is whole
    assert media.sniff(OGG + page(2, 5, b"cut short")) == [(0, len(OGG), "ogg")]


def test_jpeg_with_fill_bytes():
    at = JPEG.index(b"\xff", 2)
    filled = JPEG[:at] + b"\xff\xff" + JPEG[at:]
    assert media.sniff(filled) == [(0, len(filled), "jpeg")]
