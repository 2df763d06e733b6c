"""Streaming extensions, ours: pairing of readings that arrive apart, and latency windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_streams(first: DataFrame, second: DataFrame, wait: str = "10 minutes", key: str = "invoice_id", at: str = "read_at") -> DataFrame:
    """Full outer pairing of two streams (key, read_at, invoice).

    Readings of a document that are further apart than ``wait`` do not meet: when
    the watermark passes, the one that came is verified alone.
    """
    a = first.select(F.col(key).alias("_ka"), F.col(at).alias("_ta"), F.col("invoice").alias("_a")).withWatermark("_ta", wait)
    b = second.select(F.col(key).alias("_kb"), F.col(at).alias("_tb"), F.col("invoice").alias("_b")).withWatermark("_tb", wait)
    near = F.expr(f"_ka = _kb AND _tb >= _ta - INTERVAL {wait} AND _tb <= _ta + INTERVAL {wait}")
    both = a.join(b, near, "full")
    return both.select(F.coalesce("_ka", "_kb").alias(key), F.coalesce("_a", "_b").alias("a"), F.when(F.col("_a").isNotNull(), F.col("_b")).alias("b"))


def latency_windows(readings: DataFrame, width: str = "1 hour", wait: str = "1 hour", at: str = "read_at", engine: str = "engine", latency: str = "latency_ms") -> DataFrame:
    """Readings, mean and maximum latency a engine and tumbling window; works on streams and tables."""
    windowed = readings.withWatermark(at, wait) if readings.isStreaming else readings
    out = windowed.groupBy(F.window(at, width).alias("w"), engine).agg(F.count("*").alias("readings"), F.avg(latency).alias("mean"), F.max(latency).alias("max"))
    return out.select(F.col("w.start").alias("window_start"), engine, "readings", F.round("mean", 3).alias("mean"), "max")
