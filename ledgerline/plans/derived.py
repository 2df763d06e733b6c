"""Invoices derived from the star-schema tables, and two perturbed readings of them.

Row items come from lineitem and part, money is decimal, and every perturbation is
a function of the order's key, so both engines of a comparison derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import INVOICE, MONEY, NARROW


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt over all cores by a key: a small file is one task, however much there is to do for a row."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, idx, description, quantity, unit_price, line_total, returnflag."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag")
    quantity, price = F.col("l_quantity").cast(NARROW), F.col("p_retailprice").cast(NARROW)
    return lines.select(
        F.col("l_orderkey").alias("invoice_id"),
        (F.row_number().over(order) - 1).alias("idx"),
        F.col("p_name").alias("description"),
        quantity.alias("quantity"),
        price.alias("unit_price"),
        (quantity * price).cast(MONEY).alias("line_total"),
        F.col("l_returnflag").alias("returnflag"),
    )


def _sums() -> list[Column]:
    return [F.count("*").alias("n_items"), F.sum("line_total").cast(MONEY).alias("subtotal")]


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, items, subtotal, tax, total, printed_total, mode."""
    return _taxed(items(spark, sf_dir).groupBy("invoice_id").agg(*_sums()))


def _taxed(sums: DataFrame) -> DataFrame:
    key = F.col("invoice_id")
    rate = F.when(key % 4 == 1, F.lit("0.13")).when(key % 4 == 2, F.lit("0.16")).when(key % 4 == 3, F.lit("0.17")).cast("decimal(4,2)")
    sums = sums.withColumn("tax", (F.col("subtotal") * rate).cast(MONEY))
    sums = sums.withColumn("total", (F.col("subtotal") + F.coalesce("tax", F.lit(0).cast(MONEY))).cast(MONEY))
    corrupted = key % 5 == 0
    return sums.withColumn("mode", F.when(corrupted, F.lit("corrupted")).otherwise(F.lit("clean"))).withColumn("printed_total", F.when(corrupted, (F.col("total") + F.lit("0.60").cast(MONEY)).cast(MONEY)).otherwise(F.col("total")))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar fields of both readings: columns a_* and b_*, the truth, and the mode."""
    return _read_twice(spark, sf_dir, totals(spark, sf_dir))


def _read_twice(spark: SparkSession, sf_dir: str, totalled: DataFrame, *others: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.col("o_orderdate").alias("day"))
    base = totalled.join(orders, "invoice_id")
    key = F.col("invoice_id")
    number = F.concat(F.lit("INV-"), F.date_format("day", "yyyy"), F.lit("-"), F.lpad((key % 10000).cast("string"), 4, "0"))
    date = F.date_format("day", "yyyy-MM-dd")
    unless = lambda k, c: F.when(key % k != 0, c)
    return base.select(
        "invoice_id",
        *others,
        "mode",
        "n_items",
        number.alias("number"),
        date.alias("date"),
        F.col("total").alias("true_total"),
        unless(17, number).alias("a_number"),
        F.when(key % 19 == 0, F.lit("31-02-2025")).otherwise(date).alias("a_date"),
        unless(23, F.col("subtotal")).alias("a_subtotal"),
        F.col("tax").alias("a_tax"),
        F.col("printed_total").alias("a_total"),
        F.when(key % 7 == 0, F.concat(number, F.lit("7"))).otherwise(unless(17, number)).alias("b_number"),
        F.when(key % 19 == 0, F.lit("31-02-2025")).otherwise(date).alias("b_date"),
        unless(23, F.col("subtotal")).alias("b_subtotal"),
        F.col("tax").alias("b_tax"),
        F.when(key % 13 == 0, F.col("printed_total") + 20).otherwise(unless(11, F.col("printed_total"))).cast(MONEY).alias("b_total"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, a, b: both readings as invoices, with their rows.  Rows and sums come from one aggregation."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "description", "quantity", "unit_price", "line_total")))
    grouped = items(spark, sf_dir).groupBy("invoice_id").agg(*_sums(), rows.alias("rows"))
    key = F.col("invoice_id")
    bare = F.transform("rows", lambda x: F.struct(x["description"].alias("description"), x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price"), x["line_total"].alias("line_total")))
    fewer = F.slice(bare, F.lit(1), F.greatest(F.size("rows") - 1, F.lit(1)))
    off = F.transform(bare, lambda x, i: F.when(i == 0, x.withField("line_total", x["line_total"] + 1)).otherwise(x))
    a_rows = F.when(key % 29 == 0, off).otherwise(bare)
    b_rows = F.when(key % 29 == 0, off).when(key % 31 == 0, fewer).otherwise(bare)
    both = _read_twice(spark, sf_dir, _taxed(grouped), "rows")
    side = lambda s, r: F.struct(F.col(f"{s}_number").alias("invoice_number"), F.col(f"{s}_date").alias("date"), r.alias("line_items"), *[F.col(f"{s}_{f}").alias(f) for f in ("subtotal", "tax", "total")]).cast(INVOICE)
    return both.select("invoice_id", side("a", a_rows).alias("a"), side("b", b_rows).alias("b"))


ITEMS_SQL = """
items AS (
  SELECT l_orderkey AS invoice_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) - 1 AS INTEGER) AS idx,
         p_name AS description, CAST(l_quantity AS DECIMAL(18,4)) AS quantity, CAST(p_retailprice AS DECIMAL(18,4)) AS unit_price,
         CAST(CAST(l_quantity AS DECIMAL(18,4)) * CAST(p_retailprice AS DECIMAL(18,4)) AS DECIMAL(18,2)) AS line_total, l_returnflag AS returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

TOTALS_SQL = (
    ITEMS_SQL
    + """,
sums AS (
  SELECT invoice_id, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(line_total) AS DECIMAL(18,2)) AS subtotal FROM items GROUP BY invoice_id),
taxed AS (
  SELECT *, CAST(subtotal * CASE invoice_id % 4 WHEN 1 THEN 0.13 WHEN 2 THEN 0.16 WHEN 3 THEN 0.17 END AS DECIMAL(18,2)) AS tax FROM sums),
totalled AS (
  SELECT *, CAST(subtotal + coalesce(tax, 0) AS DECIMAL(18,2)) AS total FROM taxed),
totals AS (
  SELECT *, CASE WHEN invoice_id % 5 = 0 THEN 'corrupted' ELSE 'clean' END AS mode,
         CAST(CASE WHEN invoice_id % 5 = 0 THEN total + 0.60 ELSE total END AS DECIMAL(18,2)) AS printed_total
  FROM totalled)"""
)

SCALARS_SQL = (
    TOTALS_SQL
    + """,
named AS (
  SELECT t.*, strftime(o_orderdate, '%Y-%m-%d') AS date,
         'INV-' || strftime(o_orderdate, '%Y') || '-' || lpad(CAST(invoice_id % 10000 AS VARCHAR), 4, '0') AS number
  FROM totals t JOIN orders ON o_orderkey = invoice_id),
scalars AS (
  SELECT invoice_id, mode, n_items, number, date, total AS true_total,
         CASE WHEN invoice_id % 17 <> 0 THEN number END AS a_number,
         CASE WHEN invoice_id % 19 = 0 THEN '31-02-2025' ELSE date END AS a_date,
         CASE WHEN invoice_id % 23 <> 0 THEN subtotal END AS a_subtotal, tax AS a_tax, printed_total AS a_total,
         CASE WHEN invoice_id % 7 = 0 THEN number || '7' WHEN invoice_id % 17 <> 0 THEN number END AS b_number,
         CASE WHEN invoice_id % 19 = 0 THEN '31-02-2025' ELSE date END AS b_date,
         CASE WHEN invoice_id % 23 <> 0 THEN subtotal END AS b_subtotal, tax AS b_tax,
         CAST(CASE WHEN invoice_id % 13 = 0 THEN printed_total + 20 WHEN invoice_id % 11 <> 0 THEN printed_total END AS DECIMAL(18,2)) AS b_total
  FROM named)"""
)
