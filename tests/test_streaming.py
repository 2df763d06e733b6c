from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerline.operators.verify import verify
from ledgerline.sources.generator import generate
from ledgerline.streaming.pairing import latency_windows, pair_streams


def test_pairing_with_a_watermark(spark, tmp_path):
    made = generate(spark, 6).select("invoice_id", "invoice")
    start = datetime(2024, 1, 1)
    for side, lost in (("a", "0001"), ("b", "0002")):
        made.where(F.col("invoice_id") != lost).withColumn("read_at", F.lit(start)).write.parquet(str(tmp_path / side))
        made.limit(1).withColumn("invoice_id", F.lit("late")).withColumn("read_at", F.lit(start + timedelta(hours=2))).write.mode("append").parquet(str(tmp_path / side))
    schema = spark.read.parquet(str(tmp_path / "a")).schema
    streams = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / s)) for s in "ab"]
    verified = verify(pair_streams(*streams))
    q = verified.writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["invoice_id"]: r["reasons"] for r in spark.sql("select invoice_id, verdicts[0].reasons from paired").toDF("invoice_id", "reasons").collect()}
    assert got["0000"] == ["ENGINES_AGREE invoice_number"]
    assert got["0001"] == got["0002"] == ["SINGLE_ENGINE_CHECKS_PASS"]


def test_latency_windows(spark):
    rows = [("e", datetime(2024, 1, 1, 0, m), float(m)) for m in (0, 59)] + [("e", datetime(2024, 1, 1, 1, 0), 5.0)]
    got = [tuple(r) for r in latency_windows(spark.createDataFrame(rows, "engine string, read_at timestamp, latency_ms double")).orderBy("window_start").collect()]
    assert [(r[2], r[3], r[4]) for r in got] == [(2, 29.5, 59.0), (1, 5.0, 5.0)]
