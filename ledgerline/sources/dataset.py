"""Ground truth and meta files, the cache of raw readings, and JSON forms of invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INVOICE, META, RAW_CACHE


def _by_folder(spark: SparkSession, root: str, name: str, schema: object) -> DataFrame:
    """A file a folder; the folder's name is the id."""
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/{name}")
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{name}\z", 1).alias("invoice_id"), "*")


def read_ground_truth(spark: SparkSession, root: str) -> DataFrame:
    """invoice_id and invoice."""
    found = _by_folder(spark, root, "ground_truth.json", INVOICE)
    return found.select("invoice_id", F.struct(*INVOICE.fieldNames()).alias("invoice"))


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    return _by_folder(spark, root, "meta.json", META)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """invoice_id and the image's bytes, read only if a plan asks for them."""
    files = spark.read.format("binaryFile").load(f"{root}/*/image.png")
    return files.select(F.regexp_extract("path", r"([^/]+)/image\.png\z", 1).alias("invoice_id"), "content")


def of_split(meta: DataFrame, split: str, limit: int | None = None, limit_first: bool = False) -> DataFrame:
    """Invoices of a split in order of id.  The limit counts after the filter, or before it if ``limit_first``."""
    ordered = meta.orderBy("invoice_id")
    if limit is None:
        return ordered.where(F.col("split") == split)
    if limit_first:
        return ordered.limit(limit).where(F.col("split") == split)
    return ordered.where(F.col("split") == split).limit(limit)


def read_cache_json(spark: SparkSession, path: str) -> DataFrame:
    """A cache file as rows (engine, invoice_id, lines, latency_ms)."""
    files = spark.read.schema(RAW_CACHE).option("multiLine", True).json(path)
    engines = files.select(F.explode("engines").alias("engine", "e"))
    lines = engines.select("engine", F.col("e.latency_ms").alias("ms"), F.explode("e.lines").alias("invoice_id", "lines"))
    return lines.select("engine", "invoice_id", "lines", F.element_at("ms", F.col("invoice_id")).alias("latency_ms"))


def append_cache(readings: DataFrame, path: str) -> None:
    """Write-through cache: one folder an engine."""
    readings.select("invoice_id", "lines", "latency_ms", "engine").write.mode("append").partitionBy("engine").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("invoice_id string, lines array<string>, latency_ms double, engine string").parquet(path)


def cached_and_missing(wanted: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("engine", "invoice_id")) -> tuple[DataFrame, DataFrame]:
    """Readings that the cache has, and the keys that have to be read."""
    return cache.join(wanted.select(*keys).distinct(), list(keys), "left_semi"), wanted.join(cache.select(*keys), list(keys), "left_anti")


def invoice_from_json(text: Column) -> Column:
    """Missing scalars are null, missing rows an empty list."""
    parsed = F.from_json(text, INVOICE)
    return F.when(parsed.isNotNull(), parsed.withField("line_items", F.coalesce(parsed["line_items"], F.array().cast(INVOICE["line_items"].dataType))))


def to_json(value: Column) -> Column:
    """With null fields, as a dictionary has them."""
    return F.to_json(value, {"ignoreNullFields": "false"})
