import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import components, minhash, suffix_dedup

from .helpers import documents, empty, frame, prose, texts


def shingle_set(text, words):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(w) < words:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1))


def brute_components(rows, words, threshold=80):
    sets = [(d, shingle_set(t, words)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and None not in (a, b):
                both = len(x & y)
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    r, s = find(a), find(b)
                    parent[max(r, s)] = min(r, s)
    return {d: find(d) for d, _ in sets if d is not None}


@pytest.mark.parametrize("words", [4, 5])
def test_awkward_documents(spark, words):
    want = brute_components(texts(), words)
    sizes = defaultdict(set)
    for d, t in texts():
        sizes[d].add(len(shingle_set(t, words)))
    rows = minhash.near_duplicates(documents(spark), words).collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def gradient(n):
    """A group whose members go over into each other, strays of it, and others that share a passage."""
    draw = random.Random(9)
    base = prose(50, 160).split(" ")
    rows = []
    for k in range(n):
        words = list(base)
        for at in draw.sample(range(len(words)), draw.choice([1, 2, 3, 4, 8, 12, 16])):
            words[at] = f"w{draw.random()}"
        rows.append((k, " ".join(words)))
    passage = prose(51, 60)
    rows += [(n + k, prose(1000 + k, 40) + " " + passage) for k in range(n // 2)]
    rows += [(10 * n + k, rows[k % 5][1]) for k in range(n // 2)]
    return rows


def test_groups_that_go_over_into_each_other(spark):
    rows = gradient(120)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), 4).collect()}
    want = brute_components(rows, 4)
    missed = sum(got[d] != want[d] for d in want)
    assert missed <= 1  # banding finds a pair at the threshold with probability 0.997
    assert all(got[d] in (want[d], d) for d in want)


def test_no_documents(spark):
    assert minhash.near_duplicates(empty(spark), 4).count() == 0
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_sketches_bound_the_difference():
    draw = np.random.default_rng(3)
    for n in (5, 50, 250, 2000):
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[n // 10 :], draw.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        for kind in (minhash.NARROW, minhash.WIDE):
            x, y = (minhash.bit_sketch(s, *kind).view(np.uint8).reshape(kind[1], -1) for s in (a, b))
            assert np.unpackbits(np.bitwise_or.reduce(x ^ y, axis=0)).sum() <= apart


def test_min_hashes_estimate_similarity():
    draw = np.random.default_rng(4)
    hits = total = 0
    for _ in range(60):
        a = np.unique(draw.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[100:], draw.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)]))
        x, y = (minhash.signature(s, 9, 1) for s in (a, b))
        hits, total = hits + int((x == y).sum()), total + len(x)
    assert abs(hits / total - 0.8) < 0.05


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r["node"]: r["root"] for r in components.connect(df).collect()}
    parent = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_long_chains(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(300)], "x long, y long")
    assert {r["root"] for r in components.connect(df).collect()} == {0}


def brute_repeats(rows, depth):
    seen, out = {}, []
    for d, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - depth + 1):
            w = raw[k : k + depth]
            seen[w] = min(seen.get(w, math.inf), -math.inf if d is None else d)
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - depth + 1):
            if d is not None and seen[raw[k : k + depth]] < d:
                gone[k : k + depth] = b"\1" * depth
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g)))
    return out


def check_repeats(spark, rows, depth, gram):
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(3), depth, gram, carry=["lang", "kept", "spans", "carry_0"]).collect()
    want = brute_repeats(rows, depth)
    key = lambda r: (r[0] is not None, r[0] or 0, r[4], r[2])
    have = [(r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert {(r["carry_0"], r["carry_1"], r["carry_2"], r["carry_3"]) for r in got} == {("en", "k", "s", "c")}


def test_repeats_of_awkward_documents(spark):
    check_repeats(spark, texts(), 50, 16)


@pytest.mark.parametrize(("depth", "gram"), [(12, 4), (5, 5), (7, 1)])
def test_repeats_of_periodic_and_random_texts(spark, depth, gram, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 200)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 100)
    monkeypatch.setattr(suffix_dedup, "SORTED_WINDOWS", 30)
    draw = random.Random(depth)
    rows = [(draw.randint(0, 25), "".join(draw.choice("ab") for _ in range(draw.randint(0, 80)))) for _ in range(25)]
    rows += [(100, "ab" * 60), (101, "b" + "ab" * 40), (102, "é" * 50), (103, "xé" + "é" * 30)]
    check_repeats(spark, rows, depth, gram)


def test_blocks_make_no_difference(monkeypatch):
    text = np.frombuffer((prose(3, 400) * 3).encode(), np.uint8)
    lengths = np.array([1000, len(text) - 1000])
    one = suffix_dedup.Runs(text, lengths, 50, 16)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 128)
    two = suffix_dedup.Runs(text, lengths, 50, 16)
    windows = lambda r: sorted((s + k, d, p) for s, n, d, p in zip(r.start, r.count, r.doc, r.place) for k in range(n))
    assert windows(one) == windows(two)


@pytest.mark.parametrize("depth", [1, 8, 11, 50])
def test_groups_of_the_radix_sort_are_the_equal_windows(depth):
    draw = random.Random(depth)
    raw = bytes(draw.choice(b"ab\0\xff") for _ in range(400)) * 2
    at = np.array(draw.sample(range(len(raw) - depth), 300))
    group = np.array([draw.randrange(2) for _ in at])
    members, groups = suffix_dedup.sort_groups(np.frombuffer(raw + bytes(8), np.uint8), at, group, depth)
    want = defaultdict(set)
    for k, (a, g) in enumerate(zip(at.tolist(), group.tolist())):
        want[g, raw[a : a + depth]].add(k)
    got = defaultdict(set)
    for m, g in zip(members.tolist(), groups.tolist()):
        got[g].add(m)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    keys = [(int(group[m]), raw[at[m] : at[m] + depth]) for m in members]
    assert keys == sorted(keys)


def test_places_of_the_anchor_are_sorted_in_slices(monkeypatch):
    draw = random.Random(6)
    raw = "".join(draw.choice("ab") for _ in range(3000)).encode()
    runs = suffix_dedup.Runs(np.frombuffer(raw, np.uint8), np.array([1000, 2000]), 12, 4)
    _, covers, anchor, entry = runs.entries(raw, 12, 1)
    least = np.arange(len(covers)) % 7
    one = suffix_dedup._earlier(covers, anchor, least, 12, 4)
    monkeypatch.setattr(suffix_dedup, "SORTED_WINDOWS", 20)
    two = suffix_dedup._earlier(covers, anchor, least, 12, 4)
    assert (one[0] == two[0]).all() and one[0].any()
    seen = {}
    for c, d in zip(covers, least.tolist()):
        for k in range(len(c) - 11):
            seen[c[k : k + 12]] = min(d, seen.get(c[k : k + 12], 99))
    want = [seen[c[k : k + 12]] < d for c, d in zip(covers, least.tolist()) for k in range(len(c) - 11)]
    assert one[0].tolist() == want
