"""End-to-end plans: readings to invoices to verdicts to metrics, lazily in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import extract
from ..operators.score import eval_rows, metrics
from ..operators.verify import verify
from .engines import pairs_by_setup


def invoices_of(readings: DataFrame) -> DataFrame:
    """Readings (engine, invoice_id, lines) with their invoices; failed readings are left out."""
    return extract(readings.where(F.col("lines").isNotNull())).select("engine", "invoice_id", "invoice")


def evaluate(readings: DataFrame, setups: DataFrame, truth: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, metrics) for every setup.  Extraction runs once a reading, whatever the number of setups."""
    verified = verify(pairs_by_setup(invoices_of(readings), setups))
    rows = eval_rows(verified, truth, meta)
    return rows, metrics(rows)
