"""Recognition engines as plug-ins, and the setups that use them."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Engine(ABC):
    """Reads an image; made on the driver, loads its model on first use in a worker."""

    name = ""

    @property
    def available(self) -> bool:
        return True

    def warmup(self) -> None:
        """Load what reading needs."""

    @abstractmethod
    def read(self, image: bytes) -> list[str]:
        """The lines of an image."""


class TextEngine(Engine):
    """An engine for pages that are text already."""

    name = "text"

    def read(self, image: bytes) -> list[str]:
        return [x.strip() for x in image.decode("utf-8", "replace").splitlines() if x.strip()]


_REGISTRY: dict[str, Callable[..., Engine]] = {"text": TextEngine}


def register_engine(name: str, make: Callable[..., Engine]) -> None:
    _REGISTRY[name] = make


def get_engine(name: str, **options: object) -> Engine:
    if name not in _REGISTRY:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**options)


def read_images(images: DataFrame, engine: Engine, key: str = "invoice_id") -> DataFrame:
    """Readings (engine, key, lines, latency_ms, error); a failed reading becomes an error, not a failed job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine.warmup()
        for batch in batches:
            out: dict[str, list] = {"engine": [], key: [], "lines": [], "latency_ms": [], "error": []}
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                began, lines, error = time.perf_counter(), None, None
                try:
                    lines = engine.read(content.as_py())
                except Exception as e:  # noqa: BLE001  an engine's own errors are data here
                    error = f"{type(e).__name__}: {e}"
                for name, value in zip(out, (engine.name, k, lines, (time.perf_counter() - began) * 1000, error), strict=True):
                    out[name].append(value)
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return images.select(F.col(key).cast("string"), "content").mapInArrow(read, f"engine string, {key} string, lines array<string>, latency_ms double, error string")


def setups(spark: SparkSession, engines: list[str]) -> DataFrame:
    """Each engine alone, and the pipeline of the first two."""
    rows = [(e, "A", e) for e in engines]
    if len(engines) > 1:
        name = f"pipeline({engines[0]}+{engines[1]})"
        rows += [(name, "A", engines[0]), (name, "B", engines[1])]
    return spark.createDataFrame(rows, "setup string, role string, engine string")


def pairs_by_setup(readings: DataFrame, dimension: DataFrame, key: str = "invoice_id") -> DataFrame:
    """(setup, key, a, b) in one aggregation; a missing A is replaced by B, as one engine."""
    roles = readings.join(F.broadcast(dimension), "engine")
    pick = lambda role: F.max_by("invoice", F.when(F.col("role") == role, F.lit(1)))
    sides = roles.groupBy("setup", key).agg(pick("A").alias("x"), pick("B").alias("y"))
    return sides.select("setup", key, F.coalesce("x", "y").alias("a"), F.when(F.col("x").isNotNull(), F.col("y")).alias("b"))
