import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import verify as V
from ledgerline.operators.score import eval_rows, hit_counts, metrics
from ledgerline.plans import engines, evaluation
from ledgerline.sources import dataset, exports, generator


@pytest.fixture(scope="module")
def made(spark):
    return generator.generate(spark, 40).cache()


def test_generated_invoices_verify_green(spark, made):
    pairs = made.select("invoice_id", F.col("invoice").alias("a"), F.lit(None).cast(made.schema["invoice"].dataType).alias("b"))
    rows = V.verdict_rows(V.verify(pairs))
    assert rows.where("status <> 'green'").count() == 0


def test_generator_is_the_same_in_any_partitioning(spark):
    a = generator.generate(spark, 40).orderBy("invoice_id").collect()
    b = generator.generate(spark, 40).repartition(3).orderBy("invoice_id").collect()
    assert a == b


def test_quotas(made):
    got = {(r["split"], r["mode"]): r["count"] for r in made.groupBy("split", "mode").count().collect()}
    assert got == {("dev", "clean"): 11, ("dev", "mild"): 9, ("dev", "heavy"): 8, ("dev", "corrupted"): 4, ("eval", "clean"): 3, ("eval", "mild"): 2, ("eval", "heavy"): 1, ("eval", "corrupted"): 2}


def test_corrupted_totals_are_never_green(spark, made):
    readings = made.select(F.lit("text").alias("engine"), "invoice_id", "lines")
    rows, summary = evaluation.evaluate(readings, engines.setups(spark, ["text"]), made.select("invoice_id", "invoice"), made.select("invoice_id", "mode", "printed_total"))
    one = summary.first()
    assert one["invoices"] == 40 and one["corrupted_invoices"] == 6
    assert one["accuracy_invoice_number"] == one["accuracy_date"] == one["accuracy_subtotal"] == one["accuracy_line_items_count"] == 1.0
    assert one["accuracy_total"] == 0.85 and one["error_recall_corrupted"] == 1.0
    assert rows.where("mode = 'corrupted'").select("fields.total.correct").distinct().collect()[0][0] is False
    text = exports.markdown_report([one], [], "Report", "all")
    assert "| text | 40 |" in text
    assert exports.markdown_rows(rows).count() == 40


def test_pipeline_setup_pairs_the_first_two(spark, made):
    reading = lambda e: made.select(F.lit(e).alias("engine"), "invoice_id", "invoice")
    second = reading("y").where("invoice_id <> '0003'")
    pairs = engines.pairs_by_setup(reading("x").where("invoice_id <> '0005'").unionByName(second), engines.setups(spark, ["x", "y"]))
    both = {r["invoice_id"]: r for r in pairs.where("setup = 'pipeline(x+y)'").collect()}
    assert len(both) == 40
    assert both["0003"]["b"] is None and both["0005"]["b"] is None and both["0005"]["a"] is not None and both["0007"]["b"] is not None


def test_metrics_without_wrong_fields_are_null(spark, made):
    pairs = made.where("mode = 'clean'").select("invoice_id", F.col("invoice").alias("a"), F.col("invoice").alias("b"))
    verified = V.verify(pairs).withColumn("setup", F.lit("s"))
    one = metrics(eval_rows(verified, made, made)).first()
    assert one["flag_rate_on_wrong"] is None and one["error_recall_corrupted"] is None and one["green_precision"] == 1.0


def test_hits_need_a_truth(spark):
    inv = "struct<invoice_number:string,date:string,total:decimal(18,4)>"
    df = spark.createDataFrame([(("a", None, D(5)), ("a", "2024-01-01", None))], f"got {inv}, want {inv}")
    assert tuple(df.select(*hit_counts(F.col("got"), F.col("want"))).first()) == (1, 2)


def test_ground_truth_and_meta_files(spark, tmp_path):
    for k, tax in ((0, None), (1, 5.5)):
        d = tmp_path / f"{k:04d}"
        d.mkdir()
        (d / "ground_truth.json").write_text(json.dumps({"invoice_number": "INV-2025-0001", "date": "2025-01-01", "line_items": [{"description": "x", "quantity": 1.0, "unit_price": 2.25, "line_total": 2.25}], "subtotal": 2.25, "tax": tax, "total": 2.25}, indent=1))
        (d / "meta.json").write_text(json.dumps({"mode": "clean", "split": "eval" if k else "dev", "printed_total": None}))
    truth = {r["invoice_id"]: r["invoice"] for r in dataset.read_ground_truth(spark, str(tmp_path)).collect()}
    assert truth["0000"]["tax"] is None and truth["0001"]["tax"] == D("5.5") and truth["0000"]["line_items"][0]["unit_price"] == D("2.25")
    meta = dataset.read_meta(spark, str(tmp_path))
    assert [r["invoice_id"] for r in dataset.of_split(meta, "eval", 1).collect()] == ["0001"]
    assert dataset.of_split(meta, "eval", 1, limit_first=True).count() == 0


def test_cache(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"engines": {"e": {"lines": {"0001": ["a", "b"], "0002": []}, "latency_ms": {"0001": 5.0}}}}))
    cache = dataset.read_cache_json(spark, str(tmp_path / "cache.json"))
    got = {r["invoice_id"]: (r["lines"], r["latency_ms"]) for r in cache.collect()}
    assert got == {"0001": (["a", "b"], 5.0), "0002": ([], None)}
    dataset.append_cache(cache, str(tmp_path / "c"))
    stored = dataset.read_cache(spark, str(tmp_path / "c"))
    wanted = spark.createDataFrame([("e", "0001"), ("e", "0009"), ("f", "0001")], "engine string, invoice_id string")
    hits, misses = dataset.cached_and_missing(wanted, stored)
    assert hits.count() == 1 and {tuple(r) for r in misses.collect()} == {("e", "0009"), ("f", "0001")}


def test_invoices_from_json(spark):
    rows = [('{"invoice_number":"x","total":1.5}',), ("{}",), (None,)]
    got = [r["i"] for r in spark.createDataFrame(rows, "j string").select(dataset.invoice_from_json(F.col("j")).alias("i")).collect()]
    assert got[0]["total"] == D("1.5") and got[0]["line_items"] == [] and got[1]["date"] is None and got[2] is None


def test_exports(spark, made):
    pairs = made.limit(2).select("invoice_id", F.col("invoice").alias("a"), F.col("invoice").alias("b"))
    verified = V.verify(pairs)
    csv = exports.csv_document(verified).first()["csv"]
    assert csv.startswith("﻿field,status,value,reasons\n") and "line_items," in csv
    records = json.loads(exports.json_document(verified).first()["json"])
    assert records[0]["field"] == "invoice_number" and set(records[0]) == {"field", "status", "value", "reasons"}
    assert "tax" in json.loads(exports.result_document(verified).first()["json"])["invoice"]
    assert exports.html_document(verified).first()["html"].count("<tr>") == len(records) + 1


def test_engines(spark):
    with pytest.raises(ValueError, match="unknown engine"):
        engines.get_engine("none")

    class Fails(engines.Engine):
        name = "fails"

        def read(self, image):
            raise OSError("broken")

    pages = spark.createDataFrame([("1", bytearray(b" a \n\nb")), ("2", bytearray(b""))], "invoice_id string, content binary")
    got = {r["invoice_id"]: r for r in engines.read_images(pages, engines.get_engine("text")).collect()}
    assert got["1"]["lines"] == ["a", "b"] and got["2"]["lines"] == []
    assert all(r["lines"] is None and "broken" in r["error"] for r in engines.read_images(pages, Fails()).collect())


def test_a_run_in_one_folder(spark, made, tmp_path):
    readings = made.select(F.lit("text").alias("engine"), "invoice_id", "lines")
    rows, summary = evaluation.evaluate(readings, engines.setups(spark, ["text"]), made.select("invoice_id", "invoice"), made.select("invoice_id", "mode", "printed_total"))
    latency = spark.createDataFrame([("text", 1.0, 1.0, 2.0)], "engine string, mean double, median double, max double")
    exports.write_results(str(tmp_path / "run"), summary, latency, rows, ["text"], "dev")
    assert spark.read.json(str(tmp_path / "run/run")).first()["engines"] == ["text"]
    assert spark.read.json(str(tmp_path / "run/rows")).where("setup = 'text'").count() == 40
    report = exports.markdown_report(summary.collect(), latency.collect(), "t", "dev", exports.markdown_rows(rows).collect())
    assert "## text" in report and sum(x.startswith("| 00") for x in report.splitlines()) == 40


def test_exports_verify_once(spark):
    """The three documents come from one verification, so every table is read once."""
    import __spark_entry__ as entry

    plan = entry.queries()["result_exports"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") and plan.count("Relation [") == 3


def test_plain_dates_are_read_as_any_other(spark):
    from ledgerline.functions.text import parse_date

    days = ["2024-02-29", "2023-02-29", "0000-01-01", "0001-01-01", "2024-13-01", "2024-1-5", "on 2024-02-29", "2024-02-29 x", "2024-00-10", "9999-12-31", "2024-04-31", "", None]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select("d", parse_date("d").alias("plain"), parse_date(F.concat(F.lit("x "), "d")).alias("searched")).collect()
    assert [str(r["plain"]) for r in rows] == ["2024-02-29", "None", "None", "0001-01-01", "None", "2024-01-05", "2024-02-29", "2024-02-29", "None", "9999-12-31", "None", "None", "None"]
    assert all(r["plain"] == r["searched"] for r in rows)
