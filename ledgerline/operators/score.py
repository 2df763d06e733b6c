"""Verdicts against ground truth: per-invoice rows and one row of metrics a setup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_or_raw, money_equal
from ..schemas import NUMERIC, SCALARS
from .verify import REPORT_FIELDS, overall_worst


def value_correct(field: str, got: Column, want: Column) -> Column:
    """Numbers at cent precision, null equal to null; texts and dates must both be there."""
    if field in NUMERIC:
        return (got.isNull() & want.isNull()) | F.coalesce(money_equal(got, want), F.lit(False))
    if field == "date":
        got, want = iso_or_raw(got), iso_or_raw(want)
    return F.coalesce(got == want, F.lit(False))


def eval_rows(verified: DataFrame, truth: DataFrame, meta: DataFrame, key: str = "invoice_id") -> DataFrame:
    """One row an invoice (and setup, if there is one): acc, verdicts with correctness, overall worst."""
    joined = verified.join(truth.select(key, F.col("invoice").alias("gt")), key).join(meta.select(key, "mode", "printed_total"), key)
    own = [c for c in ("setup", key) if c in joined.columns]
    items = lambda c: F.coalesce(F.size(F.col(c)["line_items"]), F.lit(0))
    acc = [value_correct(f, F.col("merged")[f], F.col("gt")[f]).alias(f) for f in SCALARS]
    joined = joined.withColumn("acc", F.struct(*acc, (items("merged") == items("gt")).alias("line_items_count")))
    of = lambda f: F.get(F.filter("scalar_verdicts", lambda v: v["field"] == f), F.lit(0))["status"]
    status = {f: of(f) for f in SCALARS}
    fields = F.struct(*[F.struct(F.coalesce(status[f], F.lit("missing")).alias("status"), F.col(f"acc.{f}").alias("correct"), F.col("merged")[f].cast("string").alias("value")).alias(f) for f in SCALARS])
    return joined.select(*own, "mode", "printed_total", F.col("gt.total").alias("gt_total"), "acc", fields.alias("fields"), overall_worst(F.col("scalar_verdicts"), REPORT_FIELDS).alias("overall_worst"))


def metrics(rows: DataFrame, by: tuple[str, ...] = ("setup",)) -> DataFrame:
    """Field accuracy, green precision, flag rate, verifier accuracy and recall on corrupted totals."""
    green = lambda f: F.col(f"fields.{f}.status") == "green"
    good = lambda f: F.col(f"fields.{f}.correct")
    total = lambda condition: sum((condition(f).cast("int") for f in SCALARS), F.lit(0))
    counted = rows.select(
        *by,
        "acc",
        total(green).alias("green"),
        total(lambda f: green(f) & good(f)).alias("green_ok"),
        total(lambda f: ~good(f)).alias("wrong"),
        total(lambda f: ~good(f) & ~green(f)).alias("flagged"),
        total(lambda f: green(f) == good(f)).alias("right"),
        (F.col("mode") == "corrupted").alias("corrupted"),
        ((F.col("mode") == "corrupted") & ~green("total")).alias("caught"),
    )
    n = len(SCALARS)
    ratio = lambda a, b: F.round(F.try_divide(a, b), 3)
    accuracy = [F.round(F.avg(F.col(f"acc.{f}").cast("int")), 3).alias(f"accuracy_{f}") for f in (*SCALARS, "line_items_count")]
    return counted.groupBy(*by).agg(
        F.count("*").alias("invoices"),
        *accuracy,
        F.sum("green").alias("green_fields"),
        ratio(F.sum("green_ok"), F.sum("green")).alias("green_precision"),
        F.sum("wrong").alias("wrong_fields"),
        ratio(F.sum("flagged"), F.sum("wrong")).alias("flag_rate_on_wrong"),
        ratio(F.sum("right"), F.count("*") * n).alias("verifier_accuracy"),
        F.count_if("corrupted").alias("corrupted_invoices"),
        ratio(F.count_if("caught"), F.count_if("corrupted")).alias("error_recall_corrupted"),
    )


def latency_stats(df: DataFrame, engine: str = "engine", latency: str = "latency_ms") -> DataFrame:
    """Mean, interpolating median and maximum a engine, to one decimal."""
    return df.groupBy(engine).agg(*[F.round(f(latency), 1).alias(name) for name, f in (("mean", F.avg), ("median", F.median), ("max", F.max))])


def hit_counts(got: Column, want: Column) -> tuple[Column, Column]:
    """(hits, checks) over number, date and total: only where the truth has a value, dates compared as they stand."""
    hits, checks = F.lit(0), F.lit(0)
    for f in REPORT_FIELDS:
        same = money_equal(got[f], want[f]) if f == "total" else got[f] == want[f]
        there = want[f].isNotNull()
        checks = checks + there.cast("int")
        hits = hits + (there & F.coalesce(same, F.lit(False))).cast("int")
    return hits, checks


def variant_rates(df: DataFrame, by: tuple[str, ...] = ("engine", "variant")) -> DataFrame:
    """Hits, checks and percentage a variant, best first."""
    sums = df.groupBy(*by).agg(F.sum("hits").cast("long").alias("hits"), F.sum("checks").cast("long").alias("checks"))
    return sums.withColumn("pct", F.round(F.lit(100.0) * F.col("hits") / F.greatest(F.col("checks"), F.lit(1)), 1)).orderBy(F.desc(F.col("hits") / F.greatest(F.col("checks"), F.lit(1))), *by)


def otsu_threshold(bins: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The threshold with the largest between-class variance of a histogram column of small integers."""
    from pyspark.sql import Window

    counts = bins.groupBy(*by, F.col(value).cast("int").alias("t")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    step = counts.select(*by, "t", F.sum("n").over(upto).alias("below"), F.sum(F.col("n") * F.col("t")).over(upto).alias("sum_below"), F.sum("n").over(whole).alias("all"), F.sum(F.col("n") * F.col("t")).over(whole).alias("sum_all"))
    above = F.col("all") - F.col("below")
    gap = F.col("sum_below") / F.col("below") - (F.col("sum_all") - F.col("sum_below")) / F.nullif(above, F.lit(0))
    variance = F.col("below") * above * gap * gap
    return step.select(*by, "t", F.coalesce(variance, F.lit(0.0)).alias("variance")).groupBy(*by).agg(F.max(F.struct("variance", (-F.col("t")).alias("minus_t"))).alias("best")).select(*by, (-F.col("best.minus_t")).alias("threshold"), F.round("best.variance", 3).alias("variance"))
