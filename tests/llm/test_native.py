import hashlib
import re
import unicodedata

import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import chat, fingerprints

from .helpers import documents, empty, texts


def folded(text):
    text = unicodedata.normalize("NFKC", text)
    text = unicodedata.normalize("NFKC", text.casefold())
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", text).strip(" ")


def in_order(rows):
    signed = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), 42).digest(), "big", signed=True)
    return sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1]), x[1]))


def test_successors_of_ids_anywhere(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    ids = [*range(100), -(1 << 63), (1 << 63) - 1, 1 << 62, *[55] * 40, *[None] * 30]
    rows = [(d, f"text {k}") for k, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["text"]: r["next_text"] for r in fingerprints.with_successor(df).collect()}
    order = [t for _, t in in_order(rows)]
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_hot_groups_are_compared_in_parts(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 3, "B").otherwise("a").alias("text"))
    prints = docs.select("doc_id", F.lit("0" * 32).alias("fingerprint"))
    texts_of = fingerprints.fingerprint
    monkeypatch.setattr(fingerprints, "fingerprint", lambda d: texts_of(d).withColumn("fingerprint", F.lit("0" * 32)))
    odd = fingerprints.collisions(docs, prints).collect()
    assert [r["canon_sha256"] for r in odd] == [hashlib.sha256(b"b").hexdigest()]


def test_fingerprints(spark):
    rows = in_order(texts())
    got = fingerprints.fingerprint_edits(documents(spark)).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_chars"], r["edited_sha256"])
    want, prints = [], {}
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        want.append({"doc_id": d, "n_chars": len(t), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "canon": folded(t), "edited": folded(edited), "near_edited": float(folded(t) == folded(edited)), "near_next": float(folded(t) == folded(following))})
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert {c: g[c] for c in ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")} == {c: w[c] for c in ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")}
        for canon, own in ((w["canon"], g["fingerprint"]), (w["edited"], g["edited_fingerprint"])):
            assert prints.setdefault(canon, own) == own
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_nothing_and_of_one(spark):
    assert fingerprints.fingerprint_edits(empty(spark)).count() == 0
    one = documents(spark).where("doc_id = 8")
    assert fingerprints.fingerprint_edits(one).first()["near_next"] == 1.0


def test_collisions_are_told_apart(spark):
    docs = documents(spark).where("doc_id in (1, 8)")
    same = docs.select("doc_id", F.lit("0" * 32).alias("fingerprint"))
    texts_of = fingerprints.fingerprint
    try:
        fingerprints.fingerprint = lambda d: texts_of(d).withColumn("fingerprint", F.lit("0" * 32))
        assert fingerprints.collisions(docs, same).count() == 1
    finally:
        fingerprints.fingerprint = texts_of


def test_native_plans(spark):
    talk = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (chat.rotate(talk), fingerprints.fingerprint(documents(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TALK = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (1, 200, None, "late"), (2, 0, "system", "alone"), (None, None, "cat", "mew"), (None, 5, "dog", "wuff")]


def test_rotation(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in TALK], "conv_id long, turn long, role string, text string, conv string, block int")
    rows = chat.rotate(df.repartition(3)).collect()
    views = {}
    for r in rows:
        views.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cat"), (None, "dog")}
    for (conv, who), turns in views.items():
        turns.sort(key=lambda r: r["ordinal"])
        assert [r["ordinal"] for r in turns] == list(range(len(turns)))
        dialogue = "".join(r["rendered"] for r in turns)
        for r in turns:
            assert dialogue[r["start"] : r["stop"]] == r["rendered"]
            assert r["trained"] == (r["speaker"] == who)
            if r["trained"]:
                assert r["role"] == "assistant" and r["name"] is None
                assert dialogue[r["mask_start"] : r["mask_stop"]].endswith("<|im_end|>") and dialogue[r["start"] : r["mask_start"]] == "<|im_start|>assistant\n"
            elif r["speaker"] != "system":
                assert r["role"] == "user" and r["name"] == r["speaker"] and r["mask_start"] is None
        assert dialogue.count("<|im_end|>") == len(turns)
    assert len(views[(1, "ann")]) == 6
    assert chat.rotate(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, k, f"p{k % 50}", "x") for k in range(500)], "conv_id long, turn long, role string, text string")
    assert chat.rotate(alone).count() == 500


def test_long_conversations_run_over_blocks(spark):
    rows = [(1, k, f"p{k % 3}", "x" * (k % 7)) for k in range(500)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("perspective = 'p1'").orderBy("ordinal").collect()
    assert [r["turn"] for r in got] == list(range(500))
    assert all(a["stop"] == b["start"] for a, b in zip(got, got[1:]))
