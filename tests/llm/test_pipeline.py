import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from ledgerline.llm.registry import QUERIES

from .helpers import documents, empty, texts
from .test_duplicates import brute_components, brute_repeats
from .test_models import labelled


def write(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, tmp_path):
    more, labels = labelled(400)
    more = [(1000 + d, t) for d, t in more]
    from .helpers import frame

    docs = frame(spark, [*texts(), *more])
    sf = write(spark, tmp_path, docs, [(1000 + d, q, x) for d, q, x in labels])
    steps = dict(corpus_pipeline.STAGES)
    accepted = steps["quality"](spark, docs, sf)
    assert accepted.columns == docs.columns
    ids = {r["doc_id"] for r in accepted.collect()}
    assert {d for d, _ in more if d % 4 in (0, 3)} <= ids
    assert not {d for d, _ in more if d % 4 == 2} & ids

    first = documents(spark)
    kept = steps["near_dedup"](spark, first, sf)
    assert kept.columns == first.columns
    groups = brute_components(texts(), 5)
    have = sorted((r["doc_id"] or -1 for r in kept.collect()))
    assert have == sorted([d for d, root in groups.items() if d == root] + [-1, -1])

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    cut = steps["passages"](spark, kept, sf)
    assert cut.columns == first.columns and cut.schema["n_chars"].dataType == first.schema["n_chars"].dataType
    want = {(d or -1, k.decode("utf-8", "ignore")) for d, _, _, _, k in brute_repeats(rows, corpus_pipeline.PASSAGE_BYTES)}
    got = cut.collect()
    assert {(r["doc_id"] or -1, r["text"]) for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    tool = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sizes = sum(len(tool.encode(r["text"], add_special_tokens=False).ids) + 1 for r in got)
    assert sum(r["length"] for r in steps["packing"](spark, cut, sf).collect()) == sizes


def test_run(spark, tmp_path):
    sf = write(spark, tmp_path, documents(spark), [(1, 1, 0)])
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "passages", "packing"]


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, empty(spark), [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
