import base64
import hashlib
import random

import pytest

from ledgerline.llm import warc

PAGES = "page_id long, url string, html string, digest string, size int, copies long, first_id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], PAGES)


ROWS = [(3, "http://a/3", "same"), (1, "http://a b\r\n/1", "same"), (2, None, "other ünï"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "x" * 200_000), (7, "u", "x" * 200_000), (None, "u", "same")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize(("least", "revisits"), [(0, {3: 1, 5: 4, None: 1}), (3, {3: 1, None: 1}), (100, {})])
def test_round_trip(spark, least, revisits):
    path = warc.write_archives(frame(spark, ROWS), least)
    rows = warc.read_archives(spark, path).collect()
    assert all(r["gap_reason"] is None for r in rows) and len(rows) == len(ROWS)
    texts = {p: t or "" for p, _, t in ROWS}
    for r in rows:
        text = texts[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), digest(text))
        assert r["refers_to"] == revisits.get(r["page_id"])
        assert r["record_type"] == ("revisit" if r["page_id"] in revisits else "response")
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == text.encode()


def test_urls_of_any_length(spark):
    rows = [(1, "data:text/html," + "x" * 200_000, "long"), (2, "http://a/" + " " * 70_000, "blanks"), (3, "http://a/" + " " * 70_000, "long"), (4, "u", "short")]
    got = {r["page_id"]: r for r in warc.read_archives(spark, warc.write_archives(frame(spark, rows))).collect()}
    assert set(got) == {1, 2, 3, 4} and all(r["gap_reason"] is None for r in got.values())
    assert all(got[p]["target_uri"] == u.replace(" ", "%20") for p, u, _ in rows)
    assert (got[3]["record_type"], got[3]["refers_to"], bytes(got[2]["payload"])) == ("revisit", 1, b"blanks")


@pytest.mark.parametrize("gzip", [True, False])
def test_a_long_header_between_others(gzip):
    parts = [warc.make_record(k, "u" * size, b"text", None, False) for k, size in enumerate((5, 200_000, 5))]
    data = b"".join(warc.gzip_member(r) if gzip else r for r in parts)
    assert found(data) == ([warc.RECORD_ID.format(k) for k in range(3)], [])


def test_no_pages(spark):
    path = warc.write_archives(frame(spark, []))
    assert warc.read_archives(spark, path).count() == 0


def archive(n, gzip=True):
    records = [warc.make_record(k, f"http://a/{k}", random.Random(k).randbytes(300), None, False) for k in range(n)]
    return [warc.gzip_member(r) if gzip else r for r in records]


def found(data):
    out = list(warc.salvage(data))
    return [x.record_id for x in out if isinstance(x, warc.Record)], [x for x in out if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("gzip", [True, False])
def test_damage_costs_only_its_own_record(gzip):
    parts = archive(6, gzip)
    ids = [warc.RECORD_ID.format(k) for k in range(6)]
    whole = b"".join(parts)
    assert found(whole) == (ids, [])
    for at in range(len(parts[0]) + 1, len(parts[0]) + len(parts[1]) - 5, 17):
        broken = bytearray(whole)
        broken[at] ^= 0x55
        got, gaps = found(bytes(broken))
        others = [i for i in ids if i != ids[1]]
        assert others == [i for i in got if i in others]
        assert len(gaps) <= 1
        if len(got) < len(ids):
            assert (gaps[0].offset, gaps[0].length) == (len(parts[0]), len(parts[1])) and gaps[0].reason


def test_junk_between_and_cut_ends():
    parts = archive(4)
    data = b"junk\x1f\x8b\x08" + parts[0] + b"more WARC/1.1\r\n junk" + parts[1] + parts[2] + parts[3][:-20]
    got, gaps = found(data)
    assert got == [warc.RECORD_ID.format(k) for k in range(3)]
    assert [(g.offset, g.length) for g in gaps] == [(0, 7), (7 + len(parts[0]), 20), (len(data) - len(parts[3]) + 20, len(parts[3]) - 20)]


def test_a_member_of_any_size_ends_with_zero():
    big = warc.make_record(1, "u", random.Random(1).randbytes(1000) * 17_500, None, False)
    member = warc.gzip_member(big)
    assert member[-1] == 0
    assert found(member * 2)[0] == [warc.RECORD_ID.format(1)] * 2


def test_archives_are_closed_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(k, f"http://x/{k}", str(random.Random(k).random()) * 40) for k in range(60)]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    found = warc.read_archives(spark, path).collect()
    assert sorted(r["page_id"] for r in found) == list(range(60))
    assert len({r["archive"] for r in found}) > 5


def test_members_that_inflate_too_far_are_gaps(monkeypatch):
    small = warc.gzip_member(warc.make_record(1, None, b"x", None, False))
    monkeypatch.setattr(warc, "MOST_RECORD", 10_000)
    large = warc.gzip_member(warc.make_record(2, None, b"y" * 50_000, None, False))
    found = list(warc.salvage(large + small))
    assert [type(x).__name__ for x in found] == ["Gap", "Record"] and "larger" in found[0].reason
