import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import packing, token_store
from ledgerline.llm.bpe import encoder

from .helpers import documents, empty, texts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def whole(name, text):
    return Tokenizer.from_file(P.path(name)).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module", params=FILES)
def tool(request):
    return encoder(P.path(request.param)), Tokenizer.from_file(P.path(request.param))


ODD = ["a  b", "a \n b", " lead", "trail ", "  ", "", "x<|endoftext|> y", "a\x1c b", "日本 語", "it's 's 'S don't", "x\n y", "x \ny", "\n\n x", "a　 b", "ﬁ ſ İ ΑΣ.", "word,\nNext! \"quoted\" (x) don't. 3.14, é́ é."]


@pytest.mark.parametrize("text", ODD)
def test_words_equal_whole_texts(tool, text):
    fast, library = tool
    for _ in range(2):
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!aBéß1"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(tool, text):
    fast, library = tool
    assert np.frombuffer(fast.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_probes_let_words_apart(name):
    assert encoder(P.path(name))._apart and encoder(P.path(name))._fast


def test_merges_across_a_blank_are_encoded_whole(tmp_path):
    from tokenizers import models

    vocab = {c: k for k, c in enumerate("the of x a b")} | {"e ": 20, "e o": 21}
    vocab |= {c: len(vocab) + k for k, c in enumerate(set("the of x a b.\"'inñ42s7É\n\t\r") - set(vocab))}
    tool = Tokenizer(models.BPE(vocab={t: k for k, t in enumerate(vocab)}, merges=[("e", " "), ("e ", "o")]))
    path = str(tmp_path / "crossing.json")
    tool.save(path)
    ours = encoder(path)
    text = "the of the x"
    assert not ours._apart
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=700), max_size=6), st.integers(0, 3))
def test_segments_give_back_every_id(docs, shift):
    docs = [[x >> (8 * shift) for x in d] for d in docs]
    flat = [x for d in docs for x in d]
    starts = np.cumsum([0, *map(len, docs)])
    segment = token_store.Segment(token_store.pack_segment([k if k % 2 else None for k in range(len(docs))], starts, np.array(flat, np.uint32)))
    assert segment.doc_ids == [k if k % 2 else None for k in range(len(docs))]
    assert [segment.document(k).tolist() for k in range(len(docs))] == docs
    for place in range(0, len(flat), 97):
        assert segment[place] == flat[place]
    if flat:
        a, b = len(flat) // 3, len(flat)
        assert segment.ids(a, b).tolist() == flat[a:b]
    with pytest.raises(IndexError):
        segment[len(flat)]


def test_token_files(spark):
    path = token_store.write_token_files(documents(spark), P.path(FILES[0]), segment_ids=500)
    got = sorted(token_store.token_digests(spark, path).collect(), key=lambda r: r["start"])
    start, want = 0, []
    for d, t in sorted(texts(), key=lambda x: (x[0] is not None, x[0], x[1] or "")):
        ids = np.array([*whole(FILES[0], t or ""), 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    ids = {r["start"]: r["ids"] for r in token_store.read_documents(spark, path).collect()}
    assert all(len(ids[s]) == n for _, s, n, _ in want)


def test_token_files_of_nothing(spark):
    path = token_store.write_token_files(empty(spark), P.path(FILES[0]))
    assert token_store.token_digests(spark, path).count() == 0


def check_packing(rows, want_pieces, capacity):
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want_pieces)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    rows = packing.pack_documents(documents(spark), P.path(FILES[1]), with_ids=True).collect()
    want = []
    for d, t in texts():
        ids = np.array([*whole(FILES[1], t or ""), 0], "<u4")
        want += [(d or -1, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    n = check_packing(rows, want, 2048)
    assert n == -(-sum(w[3] for w in want) // 2048)
    assert all(len(r["ids"]) == r["length"] for r in rows)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(empty(spark), P.path(FILES[1])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), max_size=20))
def test_plans_place_every_piece(histogram):
    patterns = packing.plan_patterns(histogram, 32)
    placed = {}
    for members, times in patterns:
        assert sum(members) <= 32 and times > 0
        for x in members:
            placed[x] = placed.get(x, 0) + times
    assert placed == histogram
    slots = packing.plan_slots(patterns)
    ranks = {}
    for length, first, times, _, _ in slots:
        ranks.setdefault(length, []).extend(range(first, first + times))
    assert all(sorted(r) == list(range(histogram[k])) for k, r in ranks.items())
    # First-fit decreasing never needs fewer than the plan by more than a little.
    bins = []
    for x in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        for b in bins:
            if b[0] >= x:
                b[0] -= x
                break
        else:
            bins.append([32 - x])
    assert sum(t for _, t in patterns) <= 1.25 * len(bins) + 1


def test_exact_complements_come_first():
    assert packing.plan_patterns({20: 3, 12: 3}, 32) == [((20, 12), 3)]
    assert packing.plan_patterns({20: 2, 7: 2, 5: 2}, 32) == [((20, 7, 5), 2)]
    assert packing.plan_patterns({20: 1, 6: 1, 4: 1, 2: 1}, 32) == [((20, 6, 4, 2), 1)]
    assert packing.plan_patterns({}, 32) == []
