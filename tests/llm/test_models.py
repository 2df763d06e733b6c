import collections
import functools
import itertools
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import pieces, quality

from .helpers import documents, empty, frame, prose, texts

MODEL = P.path("piece_bpe_32k.model")


def unigram_proto():
    """The same pieces under a Unigram model with scores that hardly ever tie."""

    def varint(n):
        out = b""
        while True:
            n, byte = n >> 7, n & 127
            out += bytes([byte | (128 if n else 0)])
            if not n:
                return out

    field = lambda f, body: varint(f << 3 | 2) + varint(len(body)) + body
    out, k = b"", 0
    for f, v in pieces._fields(open(MODEL, "rb").read()):
        if f == 1:
            d = dict(pieces._fields(v))
            kind = d.get(3, 1)
            score = -3 - (k * 2654435761 % 99991) / 9000 if kind == 1 else 0.0
            v, k = field(1, d[1]) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind), k + 1
        elif f == 2:
            at = v.index(b"\x18\x02")
            v = v[:at] + b"\x18\x01" + v[at + 2 :]
        out += field(f, v)
    return out


@pytest.fixture(scope="module")
def models():
    return pieces.PieceModel(MODEL), pieces.PieceModel(proto=unigram_proto())


def by_scan(model, text, size, block=3):
    chunks = list(model.chunks(model.marked(text), size)) if text else []
    if not chunks:
        return []
    matrices = [model.transfer(*c) for c in chunks]
    cuts = range(0, len(chunks), block)
    ends = pieces.states_between([functools.reduce(pieces.combine, matrices[k : k + block]) for k in cuts])
    states = [0] + [s for k, a, b in zip(cuts, ends, ends[1:]) for s in pieces.states_between(matrices[k : k + block], a, b)[1:]]
    stretches = [model.between(*c, a, b) for c, a, b in zip(chunks, states, states[1:])]
    assert "".join(stretches) == model.marked(text)
    return [i for c, a, b in zip(chunks, states, states[1:]) for i in model.trace(*c, a, b)]


ODD = ["", " ", "   a  b\n\n", "日本語テキスト の" * 20, "a" * 300, "x\x00y\U0001f600é" * 20, "aaaa bbbb" * 30, "<s> a</s>", "\nabc", "\n\n x", "internationalization" * 9, prose(8, 150)]


@pytest.mark.parametrize("size", [3, 7, 64, 1000])
@pytest.mark.parametrize("text", ODD)
def test_scans_equal_the_library(models, text, size):
    bpe, unigram = models
    assert (bpe.kind, unigram.kind) == (pieces.BPE, pieces.UNIGRAM)
    assert by_scan(bpe, text, size) == bpe.library.encode(text)
    got, want = by_scan(unigram, text, size), unigram.library.encode(text)
    score = lambda ids: sum(unigram.library.get_score(i) for i in ids)
    assert unigram.library.decode(got) == unigram.library.decode(want)
    assert got == want or score(got) == pytest.approx(score(want), abs=1e-3)


def test_short_texts_of_blanks_and_letters(models):
    bpe = models[0]
    for n in range(5):
        for chars in itertools.product(" \n\ta▁é", repeat=n):
            text = "".join(chars)
            ids = bpe.library.encode(text)
            assert np.frombuffer(bpe.encode(text), "<i4").tolist() == ids
            assert by_scan(bpe, text, 2) == ids


_FUZZ = st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'aeinrstAB▁é1"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.one_of(_FUZZ, st.lists(st.sampled_from(["in", "ter", "nation", "al", "s", " ", "\n", "aa", "é", "the"]), max_size=30).map("".join)), st.sampled_from([3, 8, 64]))
def test_any_text_by_all_ways(models, text, size):
    bpe = models[0]
    ids = bpe.library.encode(text)
    assert np.frombuffer(bpe.encode(text), "<i4").tolist() == ids
    assert by_scan(bpe, text, size) == ids


def test_states_are_those_of_the_pieces_around_a_cut(models):
    bpe = models[0]
    text = bpe.marked("internationalization of the internet")
    chunks = list(bpe.chunks(text, 8))
    assert all(min(bpe.transfer(*c).shape) > 1 for c in chunks[1:-1])


@pytest.mark.parametrize("kind", [0, 1])
def test_products_are_associative(models, kind):
    model = models[kind]
    a, b, c = (model.transfer(*x) for x in model.chunks(model.marked(prose(9, 20)[:96]), 33))
    left = pieces.combine(pieces.combine(a, b), c)
    assert np.allclose(np.nan_to_num(left, neginf=-1e9), np.nan_to_num(pieces.combine(a, pieces.combine(b, c)), neginf=-1e9))


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_crc32_of_joined_strings(a, b):
    assert pieces.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("text", [*ODD, "▁x y", " lead", "trail ", "a \nb", "one\ntwo three.\n"])
def test_words_and_decoding(models, text):
    bpe = models[0]
    ids = bpe.library.encode(text)
    for _ in range(2):
        assert np.frombuffer(bpe.encode(text), "<i4").tolist() == ids
    assert bpe.decode(ids, True) == bpe.library.decode(ids)


@pytest.mark.parametrize("size", [500, 1 << 15])
def test_documents(spark, size, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHUNKS", 5)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for d, t in texts():
        ids = np.array(library.encode(t or ""), "<i4")
        want.append((d or -1, len(t or ""), len(ids), zlib.crc32(ids.tobytes()), "▁" not in (t or "")))
    got = [(r["doc_id"] or -1, *r[1:]) for r in pieces.encode_digests(documents(spark), MODEL, size).collect()]
    assert sorted(got) == sorted(want)
    assert pieces.encode_digests(empty(spark), MODEL, size).count() == 0


def test_parts_decode_to_the_text(spark):
    rows = pieces.decode_pieces(pieces.encode_pieces(documents(spark).where("doc_id = 10"), MODEL, 5000), MODEL).orderBy("part").collect()
    assert len(rows) > 1
    assert "".join(r["decoded"] for r in rows) == dict(texts())[10]


def labelled(n):
    """Good texts, texts with a bad word, and texts that repeat one word."""
    docs, labels = [], []
    for k in range(n):
        text = prose(k, 80)
        kind = k % 4
        if kind == 1:
            text = text.replace(" ", " scum ", 3)
        if kind == 2:
            text = " ".join(text.split(" ")[:3] + ["again"] * 60)
        docs.append((k, text))
        if k % 3:
            labels.append((k, 0 if kind == 2 else 1, int(kind == 1)))
    return docs, labels


def test_classifier_on_held_out_documents(spark):
    docs, labels = labelled(1200)
    tags = spark.createDataFrame([*labels, (labels[0][0], 1, 0), (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(frame(spark, docs), tags).collect()
    assert len(rows) == len(docs)
    unseen = [r for r in rows if r["doc_id"] % 3 == 0]
    right = [r["accepted"] == (r["doc_id"] % 4 in (0, 3)) for r in unseen]
    assert sum(right) / len(right) > 0.97
    clean = [r["accepted"] for r in rows if r["doc_id"] % 4 in (0, 3)]
    assert sum(clean) / len(clean) > 0.99
    drawn = sorted(quality.classify(frame(spark, docs), tags, share=0.25).collect(), key=lambda r: -r["gumbel_key"])
    assert [r["accepted"] for r in drawn] == [True] * 300 + [False] * 900
    kept = quality.keep_accepted(frame(spark, docs), quality.fit(frame(spark, docs), tags))
    assert kept.schema == frame(spark, docs).schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["accepted"]}


def test_ratios_weights_and_keys_against_brute_force(spark):
    docs, labels = labelled(600)
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(frame(spark, docs), tags)
    hashes = {r["doc_id"]: r for r in spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", f"pmod(xxhash64(doc_id, {quality.SEED}), 4) = 0 as held", f"xxhash64({quality.SEED}, doc_id) as h").collect()}
    good = {d for d, q, x in labels if q and not x}
    found = {d: quality.grams(t) for d, t in docs}
    raw, target = collections.Counter(), collections.Counter()
    for d, parts in found.items():
        for part in parts:
            raw.update(part.tolist())
            if d in good and not hashes[d]["held"]:
                target.update(part.tolist())
    size = 1 << quality.BITS
    share = [sum(n for g, n in target.items() if g // size == k) / sum(n for g, n in raw.items() if g // size == k) for k in range(quality.PARTS)]
    ratio = {g: math.log(target[g] + 1) - math.log(n * share[g // size] + 1) for g, n in raw.items()}
    assert all(abs(model.ratios[g] - r) < 1e-5 for g, r in ratio.items())
    assert np.count_nonzero(model.ratios) <= len(ratio)
    rows = quality.classify(frame(spark, docs), tags).collect()
    keys = {}
    for r in rows:
        parts = found[r["doc_id"]]
        assert r["log_weight"] == pytest.approx(sum(ratio[g] for k in (quality.UNIGRAMS, quality.BIGRAMS) for g in parts[k].tolist()), abs=1e-2)
        lacks = 0.0
        for (part, cut), threshold in zip(model.cuts, model.thresholds, strict=True):
            evidence = sum(ratio[g] for g in parts[part].tolist() if model.ratios[g] < cut)
            lacks += min(0.0, evidence - threshold)
        assert r["importance"] == pytest.approx(lacks, abs=1e-2)
        uniform = (hashes[r["doc_id"]]["h"] % (1 << 52) + 0.5) / (1 << 52)
        keys[r["doc_id"]] = quality.SHARPNESS * r["importance"] - math.log(-math.log(uniform))
        assert r["gumbel_key"] == pytest.approx(keys[r["doc_id"]], abs=1e-6)
    k = sum(r["importance"] == 0 for r in rows)
    assert {r["doc_id"] for r in rows if r["accepted"]} == set(sorted(keys, key=keys.get)[-k:])


def test_bad_texts_of_ordinary_words(spark):
    """Clean and bad texts have the same tokens; only their order, or how often a pair is there, differs."""
    words = [f"w{k}" for k in range(40)]
    docs, labels = [], []
    for k in range(900):
        draw = random.Random(k)
        pairs = [f"{a} {b}" for a, b in zip(words[::2], words[1::2], strict=True)]
        if k % 3 == 1:
            pairs = [f"{b} {a}" for a, b in zip(words[::2], words[1::2], strict=True)]
        draw.shuffle(pairs)
        if k % 3 == 2:
            pairs += ["w3 w8"] * 60
        docs.append((k, " ".join(pairs)))
        if k % 2:
            labels.append((k, int(k % 3 != 2), int(k % 3 == 1)))
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.classify(frame(spark, docs), tags).collect()
    unseen = [r for r in rows if r["doc_id"] % 2 == 0]
    assert all(r["accepted"] == (r["doc_id"] % 3 == 0) for r in unseen)
    assert {r["n_grams"] for r in rows if r["doc_id"] % 3 == 2} == {160 + 159}


def test_classifier_without_labels_or_documents(spark):
    tags = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(documents(spark), tags).where("not accepted").count() == 0
    assert quality.classify(empty(spark), tags).count() == 0


def test_kth_largest(spark):
    df = spark.range(50_000).selectExpr("cast(pmod(id * 7919, 10007) as double) as v")
    values = sorted((r["v"] for r in df.collect()), reverse=True)
    for k in (1, 2, 777, 25_000, 49_999):
        assert quality.kth_largest(df, "v", k) == values[k - 1]
    assert quality.kth_largest(df, "v", 0) == float("inf") and quality.kth_largest(df, "v", 50_000) == float("-inf")
