"""Registered queries of the verification engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lines as L
from ..operators import lookup as K
from ..operators import score as S
from ..operators import verify as V
from ..operators.extract import extract
from ..operators.localize import culprit, first_hints, hints_for
from ..operators.rows import assign, parse_rows
from ..schemas import CONFUSED_PAIRS, INVOICE, LABELS, LINE_ITEM, MONEY, NARROW, SCALARS, STATUSES
from ..sources import dataset, exports, generator
from ..streaming.pairing import latency_windows
from . import derived, engines, evaluation
from .derived import ITEMS_SQL, SCALARS_SQL, TOTALS_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _status(rank: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), rank + 1)


# --- arithmetic --------------------------------------------------------------


@query(f"""WITH {TOTALS_SQL},
v AS (SELECT mode, CASE WHEN CAST(subtotal + coalesce(tax, 0) AS DECIMAL(18,2)) = printed_total THEN 'green' ELSE 'amber' END AS status FROM totals)
SELECT mode, status, CAST(count(*) AS BIGINT) AS invoices FROM v GROUP BY mode, status""")
def corrupted_total_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total check per mode: scan, join, aggregation, predicate, verdict, aggregation."""
    t = derived.totals(spark, sf_dir)
    closes = X.money_equal(F.col("subtotal") + F.coalesce("tax", F.lit(0).cast(MONEY)), "printed_total")
    return t.groupBy("mode", F.when(closes, "green").otherwise("amber").alias("status")).agg(F.count("*").alias("invoices"))


@query(f"WITH {TOTALS_SQL} SELECT invoice_id, n_items, subtotal, tax, total FROM totals")
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.totals(spark, sf_dir).select("invoice_id", "n_items", "subtotal", "tax", "total")


@query(f"""WITH {ITEMS_SQL},
r AS (SELECT *, CAST(CASE WHEN (invoice_id + idx) % 7 = 0 THEN line_total + 1 ELSE line_total END AS DECIMAL(18,2)) AS printed FROM items)
SELECT returnflag, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN CAST(quantity * unit_price AS DECIMAL(18,2)) <> printed THEN 1 ELSE 0 END) AS BIGINT) AS broken
FROM r GROUP BY returnflag""")
def line_arithmetic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.items(spark, sf_dir)
    printed = F.when((F.col("invoice_id") + F.col("idx")) % 7 == 0, F.col("line_total") + 1).otherwise(F.col("line_total"))
    broken = V.broken_product(F.struct("quantity", "unit_price", printed.alias("line_total")))
    return rows.groupBy("returnflag").agg(F.count("*").alias("n_rows"), F.count_if(broken).alias("broken"))


@query(f"""WITH {ITEMS_SQL},
r AS (SELECT invoice_id, sum(CASE WHEN (invoice_id + idx) % 11 = 0 THEN line_total + 5 ELSE line_total END) AS s, sum(line_total) AS t FROM items GROUP BY invoice_id)
SELECT invoice_id, CAST(s AS DECIMAL(18,2)) AS row_sum, CAST(t AS DECIMAL(18,2)) AS subtotal,
       CASE WHEN CAST(s AS DECIMAL(18,2)) = CAST(t AS DECIMAL(18,2)) THEN 'green' ELSE 'amber' END AS status FROM r""")
def sum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.items(spark, sf_dir)
    printed = F.when((F.col("invoice_id") + F.col("idx")) % 11 == 0, F.col("line_total") + 5).otherwise(F.col("line_total"))
    sums = rows.groupBy("invoice_id").agg(F.collect_list(F.struct(printed.alias("line_total"))).alias("rows"), F.sum("line_total").cast(MONEY).alias("subtotal"))
    sums = sums.select("invoice_id", V.row_sum(F.col("rows")).alias("total"), "subtotal")
    return sums.select("invoice_id", X.cents("total").cast(MONEY).alias("row_sum"), "subtotal", F.when(X.money_equal("total", "subtotal"), "green").otherwise("amber").alias("status"))


_ALTERNATES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for p in CONFUSED_PAIRS for a, b in ((p[0], p[1]), (p[1], p[0]))) + ") AS alternates(digit, other)"


@query(f"""WITH {TOTALS_SQL},
broken AS (SELECT invoice_id, subtotal, printed_total AS total FROM totals WHERE mode = 'corrupted' AND tax IS NULL),
fields AS (
  SELECT invoice_id, 0 AS ord, 'subtotal' AS field, subtotal AS old, total AS goal FROM broken
  UNION ALL SELECT invoice_id, 1, 'total', total, subtotal FROM broken),
places AS (SELECT f.*, CAST(old AS VARCHAR) AS s, p FROM fields f, range(1, 30) t(p) WHERE p <= length(CAST(old AS VARCHAR))),
tries AS (
  SELECT invoice_id, ord, field, old, goal, p, other, TRY_CAST(substr(s, 1, p - 1) || other || substr(s, p + 1) AS DECIMAL(18,2)) AS new
  FROM places JOIN {_ALTERNATES_SQL} ON digit = substr(s, p, 1)),
fits AS (SELECT * FROM tries WHERE new = goal AND new <> old),
firsts AS (SELECT invoice_id, ord, field, old, p, min_by(new, other) AS new FROM fits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY ord, p) AS place FROM firsts)
SELECT invoice_id, CAST(place AS INTEGER) AS place, field, old, new FROM ranked WHERE place <= 3""")
def digit_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of untaxed corrupted totals; only violated invoices reach the search."""
    broken = derived.totals(spark, sf_dir).where((F.col("mode") == "corrupted") & F.col("tax").isNull())
    hints = first_hints(
        [
            hints_for(F.lit("subtotal"), F.col("subtotal"), lambda v: X.money_equal(v, "printed_total")),
            hints_for(F.lit("total"), F.col("printed_total"), lambda v: X.money_equal("subtotal", v)),
        ]
    )
    rows = broken.select("invoice_id", F.posexplode_outer(hints).alias("pos", "h")).where(F.col("h").isNotNull())
    return rows.select("invoice_id", (F.col("pos") + 1).alias("place"), F.col("h.key").alias("field"), F.col("h.old").cast(MONEY).alias("old"), F.col("h.new").cast(MONEY).alias("new"))


@query(f"""WITH {ITEMS_SQL},
r AS (SELECT invoice_id, idx, quantity, unit_price, CAST(line_total + CASE WHEN (invoice_id + idx) % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS printed FROM items),
broken AS (SELECT * FROM r WHERE CAST(quantity * unit_price AS DECIMAL(18,2)) <> printed),
places AS (SELECT b.*, CAST(printed AS VARCHAR) AS s, p FROM broken b, range(1, 30) t(p) WHERE p <= length(CAST(printed AS VARCHAR))),
tries AS (SELECT invoice_id, idx, p, TRY_CAST(substr(s, 1, p - 1) || other || substr(s, p + 1) AS DECIMAL(18,2)) AS new, CAST(quantity * unit_price AS DECIMAL(18,2)) AS goal
          FROM places JOIN {_ALTERNATES_SQL} ON digit = substr(s, p, 1)),
fit AS (SELECT invoice_id, idx, count(DISTINCT p) AS n FROM tries WHERE new = goal GROUP BY ALL)
SELECT CAST(coalesce(n, 0) AS BIGINT) AS repairs, CAST(count(*) AS BIGINT) AS n_rows
FROM broken LEFT JOIN fit USING (invoice_id, idx) GROUP BY 1""")
def row_total_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many digits of a broken row total can be repaired."""
    rows = derived.items(spark, sf_dir)
    printed = (F.col("line_total") + F.when((F.col("invoice_id") + F.col("idx")) % 7 == 0, 1).otherwise(0)).cast(MONEY)
    rows = rows.withColumn("printed", printed)
    product = F.col("quantity") * F.col("unit_price")
    broken = rows.where(~X.money_equal(product, "printed"))
    repairs = F.size(hints_for(F.lit("line_total"), F.col("printed"), lambda v: X.money_equal(product, v)))
    return broken.groupBy(repairs.cast("long").alias("repairs")).agg(F.count("*").alias("n_rows"))


@query(f"""WITH {SCALARS_SQL}
SELECT CASE WHEN a_tax IS NULL AND a_subtotal IS NOT NULL AND a_total = a_subtotal THEN 'confirmed' WHEN a_tax IS NULL THEN 'open' ELSE 'taxed' END AS tax_state,
       CAST(count(*) AS BIGINT) AS invoices FROM scalars GROUP BY 1""")
def no_tax_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.scalars(spark, sf_dir)
    confirmed = F.col("a_tax").isNull() & F.coalesce(X.money_equal("a_subtotal", "a_total"), F.lit(False))
    return s.groupBy(F.when(confirmed, "confirmed").when(F.col("a_tax").isNull(), "open").otherwise("taxed").alias("tax_state")).agg(F.count("*").alias("invoices"))


# --- reconciliation ----------------------------------------------------------


@query("""WITH a AS (SELECT o_orderkey AS invoice_id, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT o_orderkey AS invoice_id, CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 7 = 0 THEN 20 ELSE 0 END AS total FROM orders WHERE o_orderkey % 10 <> 4)
SELECT coalesce(a.invoice_id, b.invoice_id) AS invoice_id, CAST(coalesce(a.total, b.total) AS DECIMAL(18,2)) AS value,
       CASE WHEN a.total IS NULL THEN 'B_ONLY' WHEN b.total IS NULL THEN 'A_ONLY' WHEN a.total = b.total THEN 'AGREE' ELSE 'DIFFER' END AS outcome
FROM a FULL JOIN b ON a.invoice_id = b.invoice_id""")
def engine_agreement_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer pairing by one aggregation over both readings."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.col("o_totalprice").cast(MONEY).alias("total"))
    a = o.where(F.col("invoice_id") % 10 != 3).select("invoice_id", F.col("total").alias("ta"), F.lit(None).cast(MONEY).alias("tb"))
    shifted = (F.col("total") + F.when(F.col("invoice_id") % 7 == 0, 20).otherwise(0)).cast(MONEY)
    b = o.where(F.col("invoice_id") % 10 != 4).select("invoice_id", F.lit(None).cast(MONEY).alias("ta"), shifted.alias("tb"))
    both = a.unionByName(b).groupBy("invoice_id").agg(F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    side = lambda c: F.struct(F.col(c).alias("total"))
    return both.select("invoice_id", F.coalesce("ta", "tb").alias("value"), _outcome(V.scalar_checks("total", side("ta"), side("tb"), F.lit(False))).alias("outcome"))


def _outcome(checks: list[V.Check]) -> F.Column:
    """The kind of a field's first reason."""
    kind = F.split(F.get(V.fold(checks)["reasons"], F.lit(0)), " ")[0]
    return F.when(kind == "ENGINES_AGREE", "AGREE").when(kind == "ENGINE_DIFF", "DIFFER").otherwise(kind)


@query("""WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'a', 'o') ELSE p_name END AS b FROM part)
SELECT p_partkey, CAST(CASE WHEN a = b THEN 0 ELSE 1 END AS INTEGER) AS rank,
       round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 WHEN least(length(a), length(b)) = 0 THEN 0.0
             ELSE 1.0 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END, 6) AS similarity FROM p""")
def engine_agreement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", "a", "o")).otherwise(F.col("p_name")).alias("b"))
    rank, _ = V.agreement("name", F.col("a"), F.col("b"), False)
    return p.select("p_partkey", rank.alias("rank"), F.round(X.similarity("a", "b"), 6).alias("similarity"))


_TWO_SIDES_SQL = f"""WITH {ITEMS_SQL},
n AS (SELECT invoice_id, count(*) AS na FROM items GROUP BY invoice_id),
b AS (SELECT i.*, CASE WHEN i.invoice_id % 3 = 0 AND idx % 2 = 1 THEN quantity + 1 ELSE quantity END AS b_quantity FROM items i JOIN n USING (invoice_id) WHERE NOT (i.invoice_id % 5 = 0 AND idx = na - 1))"""


def _two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both readings by position: B lacks the last row of some, and misreads some quantities."""
    rows = derived.items(spark, sf_dir)
    last = F.col("idx") == F.count("*").over(Window.partitionBy("invoice_id")) - 1
    there = ~((F.col("invoice_id") % 5 == 0) & last)
    misread = F.when((F.col("invoice_id") % 3 == 0) & (F.col("idx") % 2 == 1), F.col("quantity") + 1).otherwise(F.col("quantity"))
    return rows.withColumn("b_quantity", F.when(there, misread)).withColumn("in_b", there)


@query(_TWO_SIDES_SQL + """, m AS (SELECT n.invoice_id, na, count(b.idx) AS nb FROM n LEFT JOIN b ON n.invoice_id = b.invoice_id GROUP BY ALL)
SELECT invoice_id, CAST(na AS BIGINT) AS rows_a, CAST(nb AS BIGINT) AS rows_b, CASE WHEN na = nb THEN 'green' ELSE 'red' END AS status FROM m""")
def row_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _two_sides(spark, sf_dir).groupBy("invoice_id").agg(F.count("*").alias("rows_a"), F.count_if("in_b").alias("rows_b"))
    return sides.withColumn("status", F.when(F.col("rows_a") == F.col("rows_b"), "green").otherwise("red"))


@query(_TWO_SIDES_SQL + """
SELECT items.returnflag, CASE WHEN b.idx IS NULL THEN 'NOT_READ_BY_B' WHEN CAST(items.quantity AS DECIMAL(18,2)) = CAST(b.b_quantity AS DECIMAL(18,2)) THEN 'AGREE' ELSE 'DIFFER' END AS outcome,
       CAST(count(*) AS BIGINT) AS n_rows
FROM items LEFT JOIN b ON items.invoice_id = b.invoice_id AND items.idx = b.idx GROUP BY 1, 2""")
def row_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _two_sides(spark, sf_dir)
    there = F.when(F.col("in_b"), F.struct(F.col("b_quantity").alias("quantity")))
    outcome = _outcome(V.part_checks("quantity", F.struct("quantity"), there, F.lit(False)))
    return sides.groupBy("returnflag", outcome.alias("outcome")).agg(F.count("*").alias("n_rows"))


@query("""WITH f AS (
  SELECT o_orderkey AS invoice_id, CASE WHEN o_orderkey % 6 <> 0 THEN 'x' END AS number, CASE WHEN o_orderkey % 4 <> 0 THEN 1 END AS tax FROM orders)
SELECT field, status, CAST(count(*) AS BIGINT) AS invoices FROM (
  SELECT 'invoice_number' AS field, CASE WHEN number IS NULL THEN 'red' ELSE 'green' END AS status FROM f
  UNION ALL SELECT 'tax', CASE WHEN tax IS NULL THEN 'amber' ELSE 'green' END FROM f) GROUP BY field, status""")
def field_presence_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields turn red when they are missing, optional ones amber."""
    k = F.col("o_orderkey")
    read = F.struct(F.when(k % 6 != 0, F.lit("x")).alias("invoice_number"), F.when(k % 4 != 0, F.lit(1).cast(NARROW)).alias("tax"))
    o = table(spark, sf_dir, "orders").select(read.alias("a"))
    rank = lambda f: V.fold(V.scalar_checks(f, F.col("a"), F.col("a"), F.lit(True)))["rank"]
    fields = o.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _status(rank(f)).alias("status")) for f in ("invoice_number", "tax")])).alias("f"))
    return fields.groupBy("f.field", "f.status").agg(F.count("*").alias("invoices"))


# --- verdicts ----------------------------------------------------------------

_SCALAR_RANKS_SQL = f"""WITH {SCALARS_SQL},
rowsums AS (SELECT invoice_id, CAST(sum(line_total) + CASE WHEN invoice_id % 29 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS s FROM items GROUP BY invoice_id),
m AS (SELECT s.*, r.s AS row_sum, coalesce(a_number, b_number) AS m_number, a_subtotal AS m_subtotal, a_tax AS m_tax, a_total AS m_total FROM scalars s JOIN rowsums r USING (invoice_id)),
c AS (SELECT *, coalesce(m_subtotal + coalesce(m_tax, 0) <> m_total, false) AS bad_total, coalesce(row_sum <> m_subtotal, false) AS bad_sum,
             m_subtotal IS NULL AND row_sum + coalesce(m_tax, 0) <> m_total AS loose FROM m),
r AS (SELECT *,
  CASE WHEN m_number IS NULL THEN 2 WHEN a_number IS NULL OR b_number IS NULL OR a_number <> b_number THEN 1 ELSE 0 END AS invoice_number_rank,
  CASE WHEN a_date = '31-02-2025' THEN 2 ELSE 0 END AS date_rank,
  CASE WHEN b_total IS NULL OR a_total <> b_total OR bad_total OR loose THEN 1 ELSE 0 END AS total_base,
  CASE WHEN m_subtotal IS NULL OR bad_total OR bad_sum THEN 1 ELSE 0 END AS subtotal_base FROM c)"""


@query(_SCALAR_RANKS_SQL + """
SELECT invoice_id, invoice_number_rank AS invoice_number, date_rank AS date, total_base > 0 AS total_flagged, subtotal_base > 0 AS subtotal_flagged,
       CASE WHEN m_tax IS NOT NULL THEN 0 WHEN subtotal_base = 0 AND total_base = 0 AND m_subtotal = m_total THEN 0 ELSE 1 END AS tax FROM r""")
def verify_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full verification of both readings; the scalars' ranks (red or amber alike for the sums)."""
    verified = V.verify(derived.readings(spark, sf_dir))
    rank = lambda f: F.get(F.filter("scalar_verdicts", lambda v: v["field"] == f), F.lit(0))["rank"]
    return verified.select("invoice_id", rank("invoice_number").alias("invoice_number"), rank("date").alias("date"), (rank("total") > 0).alias("total_flagged"), (rank("subtotal") > 0).alias("subtotal_flagged"), rank("tax").alias("tax"))


@query()
def verify_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a verdict, with reasons and hints."""
    return V.verdict_rows(V.verify(derived.readings(spark, sf_dir)))


@query(f"""WITH {SCALARS_SQL},
c AS (
  SELECT invoice_id, 1 AS seq, CASE WHEN a_number IS NULL THEN 2 ELSE 0 END AS rank, 'number' AS reason FROM scalars
  UNION ALL SELECT invoice_id, 2, CASE WHEN a_date = '31-02-2025' THEN 2 ELSE 0 END, 'date' FROM scalars
  UNION ALL SELECT invoice_id, 3, CASE WHEN a_subtotal IS NULL THEN 1 ELSE 0 END, 'subtotal' FROM scalars
  UNION ALL SELECT invoice_id, 4, CASE WHEN a_subtotal + coalesce(a_tax, 0) <> a_total THEN 1 ELSE 0 END, 'total' FROM scalars)
SELECT invoice_id, CASE max(rank) WHEN 0 THEN 'green' WHEN 1 THEN 'amber' ELSE 'red' END AS status,
       CASE max(rank) WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS confidence,
       coalesce(string_agg(CASE WHEN rank > 0 THEN reason END, '; ' ORDER BY seq), '') AS reasons FROM c GROUP BY invoice_id""")
def verdict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold alone: checks of an invoice to status, confidence and ordered reasons."""
    s = derived.scalars(spark, sf_dir)
    bad = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        V.Check(F.col("a_number").isNull(), 2, "number"),
        V.Check(bad(X.parse_date("a_date").isNull()), 2, "date"),
        V.Check(F.col("a_subtotal").isNull(), 1, "subtotal"),
        V.Check(bad(~X.money_equal(F.col("a_subtotal") + F.coalesce("a_tax", F.lit(0).cast(MONEY)), "a_total")), 1, "total"),
    ]
    folded = s.select("invoice_id", V.fold(checks).alias("f"))
    return folded.select("invoice_id", _status(F.col("f.rank")).alias("status"), F.col("f.confidence").alias("confidence"), F.array_join("f.reasons", "; ").alias("reasons"))


@query(_SCALAR_RANKS_SQL + """
SELECT greatest(invoice_number_rank, date_rank) = 2 AS number_or_date_red, total_base > 0 AS total_flagged, CAST(count(*) AS BIGINT) AS invoices FROM r GROUP BY 1, 2""")
def overall_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two overall verdicts (three fields, six fields) rest on these."""
    verified = V.verify(derived.readings(spark, sf_dir))
    two = V.overall_worst(F.col("scalar_verdicts"), ("invoice_number", "date")) == "red"
    total = V.overall_worst(F.col("scalar_verdicts"), ("total",)) != "green"
    return verified.groupBy(two.alias("number_or_date_red"), total.alias("total_flagged")).agg(F.count("*").alias("invoices"))


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN bal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM (
  SELECT 'customer' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY kind""")
def negative_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(V.fold(V.format_checks("total", F.struct(F.col("bal").alias("total"))))["rank"] == 2).alias("negative"))


@query(r"""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'INV ' || o_orderkey WHEN 2 THEN 'INV-' || o_orderkey || chr(10) WHEN 3 THEN repeat('9', 31) ELSE 'INV-' || o_orderkey END AS number FROM orders)
SELECT o_orderkey, regexp_full_match(number, '\S{2,30}') AS valid FROM n""")
def invoice_no_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = k.cast("string")
    number = F.when(k % 5 == 0, F.lit("I")).when(k % 5 == 1, F.concat(F.lit("INV "), text)).when(k % 5 == 2, F.concat(F.lit("INV-"), text, F.lit("\n"))).when(k % 5 == 3, F.repeat(F.lit("9"), 31)).otherwise(F.concat(F.lit("INV-"), text))
    return table(spark, sf_dir, "orders").select("o_orderkey", (V.fold(V.format_checks("invoice_number", F.struct(number.alias("invoice_number"))))["rank"] == 0).alias("valid"))


# --- text --------------------------------------------------------------------


@query("""WITH d AS (SELECT o_orderkey, o_orderdate AS d, CAST(o_orderkey % 28 + 4 AS VARCHAR) AS day, CAST(o_orderkey % 12 + 1 AS VARCHAR) AS month FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN strftime(d, '%d-%m-%Y') ELSE strftime(d, '%Y/%m/%d') END AS VARCHAR) AS printed,
       CAST(d AS DATE) AS parsed, strftime(d, '%Y-%m-%d') AS iso, TRY_CAST('2023-' || month || '-' || day AS DATE) IS NOT NULL AS real_day FROM d""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both date styles, half of them in Urdu digits, and days that may not exist."""
    o = table(spark, sf_dir, "orders")
    printed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    o = o.select("o_orderkey", printed.alias("printed"))
    text = F.when(F.col("o_orderkey") % 3 == 0, X.urdu_digits("printed")).otherwise(F.col("printed"))
    made = F.concat_ws(".", (F.col("o_orderkey") % 28 + 4).cast("string"), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit("2023"))
    return o.select("o_orderkey", "printed", X.parse_date(text).alias("parsed"), X.iso_date(text).alias("iso"), X.parse_date(made).isNotNull().alias("real_day"))


@query(r"""SELECT doc_id, TRY_CAST(replace(nullif(regexp_extract(text, '-?[0-9][0-9,]*(?:\.[0-9]+)?'), ''), ',', '') AS DECIMAL(38,4)) AS amount FROM documents""")
def parse_amount_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.parse_amount("text").alias("amount"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(translate(text, 'ki', 'کی'), '[ \t]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean FROM conversations""")
def normalize_digits_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose digits and some letters stand in Arabic forms, with marks that are dropped, unified."""
    t = table(spark, sf_dir, "conversations")
    written = F.regexp_replace(F.translate("text", "0123456789ki", "٠١٢٣٤٥٦٧٨٩كي"), "e", "e\u200c")
    return t.select("conv_id", "turn", X.normalize_digits(written).alias("clean"))


@query(r"""SELECT page_id, trim(regexp_replace(html, '[ \t]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean FROM pages""")
def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_digits("html").alias("clean"))


@query()
def normalize_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full canonical form of every document; SQL has no compatibility composition."""
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_text("text").alias("clean"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance, CAST(least(levenshtein(a.p_name, b.p_name), 4) AS INTEGER) AS bounded
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    b = p.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, "a").select("a", "b", X.edit_distance("x", "y").alias("distance"), X.edit_distance("x", "y", 3).alias("bounded"))


@query("""WITH chars AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark),
odd AS (SELECT ch, row_number() OVER (ORDER BY ch) AS k FROM chars WHERE unicode(ch) > 127),
free AS (SELECT chr(CAST(i AS INTEGER)) AS ch, row_number() OVER (ORDER BY i) AS k FROM range(1, 128) t(i) WHERE chr(CAST(i AS INTEGER)) NOT IN (SELECT ch FROM chars)),
m AS (SELECT coalesce(string_agg(odd.ch, '' ORDER BY k), '') AS f, coalesce(string_agg(free.ch, '' ORDER BY k), '') AS t FROM odd JOIN free USING (k)),
b AS (SELECT item_id, translate(text, f, t) AS text FROM benchmark, m)
SELECT a.item_id AS a, b.item_id AS b, round(1.0 - CAST(levenshtein(a.text, b.text) AS DOUBLE) / greatest(length(a.text), length(b.text)), 6) AS similarity
FROM b a JOIN b ON b.item_id = a.item_id + 1""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in any script.  DuckDB counts bytes, so its SQL first gives each other character one of ASCII that the table lacks."""
    t = table(spark, sf_dir, "benchmark")
    a = t.select(F.col("item_id").alias("a"), F.col("text").alias("x"))
    b = t.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(X.similarity("x", "y"), 6).alias("similarity"))


@query(r"""SELECT doc_id, CAST(ord - 1 AS INTEGER) AS line_no, line FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ord FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'), lambda x: trim(x, chr(32) || chr(9)) <> '') AS l FROM documents))""")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(L.text_lines(F.col("text"))).alias("line_no", "line"))


def _anchors_sql(line: str) -> str:
    """Cuts before every label: a label that has another one inside goes first."""
    labels = {w for words in LABELS.values() for w in words}
    for w in sorted(labels, key=lambda w: (-len(w), w)):
        line = f"replace({line}, '{w}', chr(1) || '{w}')"
    return line


_DATE_SQL = X.DATE_TOKEN
_EDGES_SQL = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"


@query(rf"""WITH o AS (SELECT doc_id, regexp_replace(text || ' ' || 'Date: 15-06-2025 Sub Total: 10 Grand Total: 20 INV-2025' || ' ' || doc_id, '\s+', ' ', 'g') AS line FROM documents),
m AS (SELECT doc_id, {_anchors_sql("line")} AS line FROM o),
n AS (SELECT doc_id, regexp_replace(regexp_replace(line, '((?i:INV)[-\s]?\d{{4}})', chr(1) || '\1', 'g'), '({_DATE_SQL})', chr(1) || '\1', 'g') AS line FROM m),
p AS (SELECT doc_id, list_filter(list_transform(string_split(line, chr(1)), lambda x: regexp_replace(x, {_EDGES_SQL})), lambda x: x <> '') AS l FROM n)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS piece, unnest(l) AS line FROM p""")
def long_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one long line, with labels, a date and its key at the end, cut at its anchors."""
    d = table(spark, sf_dir, "documents")
    one = F.regexp_replace(F.concat_ws(" ", "text", F.lit("Date: 15-06-2025 Sub Total: 10 Grand Total: 20 INV-2025"), F.col("doc_id").cast("string")), r"\s+", " ")
    long = F.rpad(one, F.greatest(F.char_length(one), F.lit(200)), F.lit(" "))
    return d.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(L.split_long_line(long)).alias("piece", "line"))


@query(f"""WITH {TOTALS_SQL}
SELECT invoice_id, CASE WHEN total = floor(total) THEN format('{{:,}}', CAST(total AS BIGINT)) ELSE format('{{:,}}', CAST(floor(total) AS BIGINT)) || '.' || lpad(CAST(CAST((total - floor(total)) * 100 AS BIGINT) AS VARCHAR), 2, '0') END AS printed,
       format('{{:,}}', CAST(floor(total) AS BIGINT)) || '.' || lpad(CAST(CAST((total - floor(total)) * 100 AS BIGINT) AS VARCHAR), 2, '0') AS shown FROM totals""")
def render_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.totals(spark, sf_dir).select("invoice_id", X.grouped("total").alias("printed"), X.shown("total").alias("shown"))


# --- extraction --------------------------------------------------------------

_PRINTED_SQL = f"""WITH {SCALARS_SQL},
p AS (SELECT invoice_id, true_total, number, date, CAST(true_total AS VARCHAR) AS amount FROM scalars)"""


def _printed(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Pages of three lines; a third has its value on the line after the label."""
    s = derived.scalars(spark, sf_dir)
    amount = F.col("true_total").cast("string")
    total = F.when(F.col("invoice_id") % 3 == 0, F.array(F.lit(label), amount)).otherwise(F.array(F.concat(F.lit(f"{label}: "), amount)))
    head = F.array(F.concat(F.lit("Invoice No: "), F.col("number")), F.concat(F.lit("Date: "), F.col("date")))
    return s.select("invoice_id", "number", "date", "true_total", F.concat(head, total).alias("lines"))


@query(_PRINTED_SQL + " SELECT invoice_id, number, date, true_total AS total FROM p")
def extract_exact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lookup on the same line and on the next one."""
    pages = _printed(spark, sf_dir, "Grand Total")
    ls = F.col("lines")
    return pages.select("invoice_id", K.lookup_exact(ls, LABELS["invoice_number"], r"\S+").alias("number"), K.lookup_exact(ls, LABELS["date"], X.DATE_TOKEN).alias("date"), X.amount_of(K.lookup_amount(ls, LABELS["total"])).cast(MONEY).alias("total"))


@query(_PRINTED_SQL + " SELECT invoice_id, true_total AS total FROM p")
def extract_fuzzy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label with two wrong letters is still found, by distance."""
    pages = _printed(spark, sf_dir, "Amoumt Payeble")
    return pages.select("invoice_id", X.amount_of(K.lookup_amount(F.col("lines"), LABELS["total"])).cast(MONEY).alias("total"))


@query(f"""WITH {SCALARS_SQL},
n AS (SELECT invoice_id, strftime(o_orderdate, '%Y') AS y, lpad(CAST(invoice_id % 10000 AS VARCHAR), 4, '0') AS k FROM scalars JOIN orders ON o_orderkey = invoice_id)
SELECT invoice_id, CASE WHEN NOT CAST(y AS INTEGER) BETWEEN 2020 AND 2035 AND CAST(k AS INTEGER) BETWEEN 2020 AND 2035 THEN 'INV-' || k || '-' || y ELSE 'INV-' || y || '-' || k END AS number FROM n""")
def invoice_no_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A garbled label: the number is found by its shape.  The digits that are no year stay second."""
    s = derived.scalars(spark, sf_dir)
    garbled = F.concat(F.lit("inv - n0 :"), F.regexp_replace(F.col("number"), "INV", ""))
    return s.select("invoice_id", K.number_by_shape(F.array(F.lit("x"), F.regexp_replace(garbled, "n0", ""))).alias("number"))


_ROWS_SQL = f"""WITH {ITEMS_SQL}
SELECT invoice_id, idx, description, quantity, unit_price, CAST(line_total AS DECIMAL(18,4)) AS line_total FROM items"""


def _parsed(spark: SparkSession, sf_dir: str, lines: Callable[[], F.Column]) -> DataFrame:
    rows = derived.items(spark, sf_dir).select("invoice_id", "idx", parse_rows(lines()).alias("found"))
    rows = rows.select("invoice_id", "idx", F.explode_outer("found").alias("x"))
    return rows.select("invoice_id", "idx", "x.description", *[F.col(f"x.{p}").cast(NARROW).alias(p) for p in ("quantity", "unit_price", "line_total")])


@query(_ROWS_SQL)
def row_parse_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.col(c).cast("string")
    return _parsed(spark, sf_dir, lambda: F.array(F.concat_ws("  ", "description", number("quantity"), number("unit_price"), number("line_total"))))


@query(f"""WITH {ITEMS_SQL}
SELECT invoice_id, idx, description, CASE WHEN quantity = 1 THEN unit_price ELSE quantity END AS quantity, CASE WHEN quantity = 1 THEN 1 ELSE unit_price END::DECIMAL(18,4) AS unit_price,
       CAST(line_total AS DECIMAL(18,4)) AS line_total FROM items""")
def row_parse_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that lead the line.  With a quantity of 1 price and amount are equal, and the first product that closes decides."""
    number = lambda c: F.col(c).cast("string")
    return _parsed(spark, sf_dir, lambda: F.array(F.concat_ws("  ", number("line_total"), number("unit_price"), number("quantity"), "description")))


@query(_ROWS_SQL)
def row_parse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers on one line, the description on the next."""
    number = lambda c: F.col(c).cast("string")
    return _parsed(spark, sf_dir, lambda: F.array(F.concat_ws("  ", number("quantity"), number("unit_price"), number("line_total")), F.col("description")))


@query(f"""WITH {ITEMS_SQL}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN quantity = unit_price THEN 1 ELSE 0 END) AS BIGINT) AS square FROM items""")
def column_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the three numbers that closes gives back quantity, price and amount."""
    rows = derived.items(spark, sf_dir)
    q, p, t = F.col("quantity"), F.col("unit_price"), F.col("line_total").cast("decimal(18,4)")
    a, b, c = assign(q, p, t, F.lit(False))
    right = (a == q) & (b == p) & (c == t)
    return rows.where(right).agg(F.count("*").alias("n_rows"), F.count_if(q == p).alias("square"))


@query(f"""WITH {ITEMS_SQL}
SELECT invoice_id, idx, description, quantity, unit_price, CAST(line_total AS DECIMAL(18,4)) AS line_total FROM items""")
def row_parse_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between labelled lines, dates, lines of two and of four numbers only the row is an item."""
    number = lambda c: F.col(c).cast("string")
    row = F.concat_ws("  ", "description", number("quantity"), number("unit_price"), number("line_total"))
    others = ["Sub Total 1 2 3", "x 12-05-2024 7 8", "Grand Total: 4 5 6", "two 1 2", "four 1 2 3 4", "Date 1 2 3", "12.05.2024"]
    return _parsed(spark, sf_dir, lambda: F.concat(F.array(*map(F.lit, others[:4])), F.array(row), F.array(*map(F.lit, others[4:]))))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE '2024/02/29' END AS token FROM orders""")
def first_valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line whose first date is a calendar day; a day that does not exist, and what follows it on its line, is passed over."""
    k = F.col("o_orderkey")
    day = F.concat(F.lit("on "), F.date_format("o_orderdate", "dd-MM-yyyy"))
    lines = F.array(F.lit("no date here 12"), F.lit("31-02-2025 and 01-03-2025"), F.when(k % 3 == 1, day).when(k % 3 == 2, F.lit("x 2024/02/29 y 2023-01-01")).otherwise(F.lit("99/99/2024")), F.lit("45.45.2024"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.first_valid_date(lines).alias("token"))


@query("""SELECT o_orderkey, '1234567890123456' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '.5000' AS total, CAST(4 AS INTEGER) AS n_items,
       '3217654321.0000' AS price, o_orderkey % 2 = 0 AS closes, CASE WHEN o_orderkey % 2 = 0 THEN 'green' ELSE 'amber' END AS row_status FROM orders""")
def large_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telephone numbers, numbers of twenty digits and huge totals go through extraction and verification as any other."""
    k = F.col("o_orderkey")
    total = F.concat(F.lit("Total: 1234567890123456"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(".5"))
    product = F.when(k % 2 == 0, F.lit("big 9999999999 9999999999 99999999980000000001")).otherwise(F.lit("big 9999999999 9999999999 99999999980000000007"))
    far = F.lit("far 99999999999999999999999999999999 99999999999999999999999999999999 5")
    lines = F.array(F.lit("Contact 3001234567 3217654321 5"), F.lit("ref 12345678901234567890 333 500"), product, far, total)
    orders = derived.spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    read = extract(orders.select(k.alias("invoice_id"), lines.alias("lines")))
    verified = V.verify(read.select("invoice_id", F.col("invoice").alias("a"), F.lit(None).cast(read.schema["invoice"].dataType).alias("b")))
    items = F.col("merged.line_items")
    status = F.get(F.filter("verdicts", lambda v: v["field"] == "line_items[2].quantity"), F.lit(0))["status"]
    return verified.select(F.col("invoice_id").alias("o_orderkey"), F.col("merged.total").cast("string").alias("total"), F.size(items).alias("n_items"), F.get(items, F.lit(0))["unit_price"].cast("string").alias("price"), (~V.broken_product(F.get(items, F.lit(2)))).alias("closes"), status.alias("row_status"))


# --- generator, evaluation, exports -------------------------------------------


def _n(spark: SparkSession, sf_dir: str, name: str = "supplier") -> int:
    """As many generated invoices as the table has rows."""
    return table(spark, sf_dir, name).count()


@query("""WITH n AS (SELECT count(*) AS n, least(20, count(*) // 5) AS held FROM orders),
s AS (SELECT 'dev' AS split, n - held AS size, 0.35::DOUBLE AS clean, 0.30::DOUBLE AS mild, 0.25::DOUBLE AS heavy FROM n
UNION ALL SELECT 'eval', held, 0.40::DOUBLE, 0.25::DOUBLE, 0.15::DOUBLE FROM n),
c AS (SELECT split, size, floor(size * clean) AS clean, floor(size * mild) AS mild, floor(size * heavy) AS heavy FROM s),
m AS (SELECT split, 'clean' AS mode, clean AS k FROM c UNION ALL SELECT split, 'mild', mild FROM c UNION ALL SELECT split, 'heavy', heavy FROM c
UNION ALL SELECT split, 'corrupted', size - clean - mild - heavy FROM c)
SELECT split, mode, CAST(k AS BIGINT) AS invoices FROM m WHERE k > 0""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quotas for as many invoices as there are orders."""
    n = _n(spark, sf_dir, "orders")
    return generator.stratified_modes(spark.range(n), n).groupBy("split", "mode").agg(F.count("*").alias("invoices"))


@query()
def generate_and_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated pages to invoices: the truth comes back, but for corrupted totals."""
    made = generator.generate(spark, _n(spark, sf_dir)).withColumnRenamed("invoice", "truth")
    got = extract(made)
    return got.select("invoice_id", "mode", (F.col("invoice.invoice_number") == F.col("truth.invoice_number")).alias("number_ok"), (F.col("invoice.date") == F.col("truth.date")).alias("date_ok"), X.money_equal("invoice.total", "truth.total").alias("total_ok"), F.size("invoice.line_items").alias("n_items"))


@query()
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two noisy readings of generated pages, each alone and paired: metrics a setup."""
    made = generator.generate(spark, _n(spark, sf_dir))
    reading = lambda engine, rate: made.select(F.lit(engine).alias("engine"), "invoice_id", generator.misread(F.col("lines"), rate, F.lit(engine), F.col("invoice_id")).alias("lines"))
    readings = reading("first", 8).unionByName(reading("second", 15))
    _, metrics = evaluation.evaluate(readings, engines.setups(spark, ["first", "second"]), made.select("invoice_id", "invoice"), made.select("invoice_id", "mode", "printed_total"))
    return metrics


@query("""WITH t AS (SELECT l.doc_id, quality, toxic, d.lang, l.doc_id % 5 = 0 AS corrupted FROM labels l JOIN documents d USING (doc_id)),
v AS (SELECT lang, corrupted, quality = 1 AS ok, toxic = 0 AS green FROM t)
SELECT lang, CAST(count(*) AS BIGINT) AS invoices, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 3) AS accuracy_total,
       CAST(sum(CASE WHEN green THEN 5 ELSE 0 END) AS BIGINT) AS green_fields,
       round(sum(CASE WHEN green AND ok THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN green THEN 1 ELSE 0 END), 0), 3) AS green_precision,
       CAST(sum(CASE WHEN ok THEN 0 ELSE 5 END) AS BIGINT) AS wrong_fields,
       round(sum(CASE WHEN NOT ok AND NOT green THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN NOT ok THEN 1 ELSE 0 END), 0), 3) AS flag_rate_on_wrong,
       round(avg(CASE WHEN ok = green THEN 1 ELSE 0 END), 3) AS verifier_accuracy,
       CAST(sum(CASE WHEN corrupted THEN 1 ELSE 0 END) AS BIGINT) AS corrupted_invoices,
       round(sum(CASE WHEN corrupted AND NOT green THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN corrupted THEN 1 ELSE 0 END), 0), 3) AS error_recall_corrupted
FROM v GROUP BY lang""")
def label_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics on labelled documents: quality says whether a field is right, toxicity whether it is flagged."""
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    ok, status = F.col("quality") == 1, F.when(F.col("toxic") == 0, "green").otherwise("amber")
    fields = F.struct(*[F.struct(status.alias("status"), ok.alias("correct")).alias(f) for f in SCALARS])
    acc = F.struct(*[ok.alias(f) for f in (*SCALARS, "line_items_count")])
    rows = t.select("lang", fields.alias("fields"), acc.alias("acc"), F.when(F.col("doc_id") % 5 == 0, "corrupted").otherwise("clean").alias("mode"))
    return S.metrics(rows, ("lang",)).select("lang", "invoices", "accuracy_total", "green_fields", "green_precision", "wrong_fields", "flag_rate_on_wrong", "verifier_accuracy", "corrupted_invoices", "error_recall_corrupted")


@query("""SELECT event_type AS engine, round(avg(value), 1) AS mean, round(median(value), 1) AS median, round(max(value), 1) AS max FROM events GROUP BY event_type""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latency_stats(table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("value").alias("latency_ms")))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type AS engine, CAST(count(*) AS BIGINT) AS readings, max(value) AS max FROM events GROUP BY 1, 2""")
def latency_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("read_at"), F.col("event_type").alias("engine"), F.col("value").alias("latency_ms"))
    return latency_windows(e).drop("mean")


@query("""WITH r AS (SELECT o_orderpriority AS engine, o_orderstatus AS variant, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS hits, 3 AS checks FROM orders)
SELECT engine, variant, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(checks) AS BIGINT) AS checks, round(100.0 * sum(hits) / greatest(sum(checks), 1), 1)::DOUBLE AS pct FROM r GROUP BY 1, 2""")
def variant_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("engine"), F.col("o_orderstatus").alias("variant"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(3).alias("hits"), F.lit(3).alias("checks"))
    return S.variant_rates(o)


@query("""WITH h AS (SELECT event_type, CAST(floor(value) AS INTEGER) % 256 AS t FROM events),
c AS (SELECT event_type, t, count(*) AS n FROM h GROUP BY 1, 2),
w AS (SELECT event_type, t, sum(n) OVER u AS below, sum(n * t) OVER u AS sb, sum(n) OVER a AS alln, sum(n * t) OVER a AS sa FROM c
      WINDOW u AS (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY event_type)),
v AS (SELECT event_type, t, coalesce(CAST(below AS DOUBLE) * (alln - below) * pow(CAST(sb AS DOUBLE) / below - CAST(sa - sb AS DOUBLE) / nullif(alln - below, 0), 2), 0) AS variance FROM w)
SELECT event_type, CAST(arg_min(t, (-variance, t)) AS INTEGER) AS threshold FROM v GROUP BY event_type""")
def histogram_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between-class variance over a histogram of 256 bins."""
    e = table(spark, sf_dir, "events").select("event_type", (F.floor("value").cast("int") % 256).alias("bin"))
    return S.otsu_threshold(e, "bin", ("event_type",)).select("event_type", "threshold")


@query(f"""WITH {ITEMS_SQL} SELECT invoice_id, CAST(max(length(CAST(CAST(quantity AS INTEGER) AS VARCHAR))) AS INTEGER) AS quantity_width, CAST(max(length(CAST(line_total AS VARCHAR))) AS INTEGER) AS total_width FROM items GROUP BY invoice_id""")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.items(spark, sf_dir)
    return rows.groupBy("invoice_id").agg(F.max(F.char_length(X.grouped("quantity"))).alias("quantity_width"), F.max(F.char_length(F.col("line_total").cast("string"))).alias("total_width"))


@query("""SELECT o_orderkey % 4 <> 0 AS cached, CAST(count(*) AS BIGINT) AS readings FROM orders GROUP BY 1""")
def cache_hits_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.lit("first").alias("engine"), F.col("o_orderkey").alias("invoice_id"))
    cache = keys.where(F.col("invoice_id") % 4 != 0).withColumn("lines", F.array(F.lit("x")))
    hits, misses = dataset.cached_and_missing(keys, cache)
    return hits.select(F.lit(True).alias("cached")).unionByName(misses.select(F.lit(False).alias("cached"))).groupBy("cached").agg(F.count("*").alias("readings"))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10)""")
def limit_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that is the feature: the first ten of a split."""
    return dataset.of_split(_splits(spark, sf_dir), "F", 10).select(F.col("invoice_id").alias("o_orderkey"))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10) WHERE o_orderstatus = 'F'""")
def limit_before_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other order: those of the first ten that are in the split."""
    return dataset.of_split(_splits(spark, sf_dir), "F", 10, limit_first=True).select(F.col("invoice_id").alias("o_orderkey"))


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.col("o_orderstatus").alias("split"))


@query("""WITH s(setup, role, engine) AS (VALUES ('A', 'A', 'A'), ('N', 'A', 'N'), ('R', 'A', 'R'), ('pipeline(A+N)', 'A', 'A'), ('pipeline(A+N)', 'B', 'N'))
SELECT setup, role, CAST(count(*) AS BIGINT) AS readings FROM lineitem JOIN s ON l_returnflag = engine GROUP BY 1, 2""")
def setup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings joined to the dimension of setups: each engine alone, and the first two as a pipeline."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("engine"))
    return r.join(F.broadcast(engines.setups(spark, ["A", "N", "R"])), "engine").groupBy("setup", "role").agg(F.count("*").alias("readings"))


@query(f"""WITH {TOTALS_SQL}, e(invoice_id, why) AS (VALUES (1, 'first'), (5, 'corrupted'), (10, 'corrupted'))
SELECT CAST(e.invoice_id AS BIGINT) AS invoice_id, why, mode, printed_total FROM e JOIN totals ON totals.invoice_id = e.invoice_id""")
def example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.createDataFrame([(1, "first"), (5, "corrupted"), (10, "corrupted")], "invoice_id long, why string")
    return derived.totals(spark, sf_dir).join(F.broadcast(chosen), "invoice_id").select("invoice_id", "why", "mode", "printed_total")


@query(f"""WITH {SCALARS_SQL}
SELECT invoice_id, a_number AS number, a_date AS date, CAST(a_subtotal AS DECIMAL(18,2)) AS subtotal, a_tax IS NULL AS untaxed, CAST(n_items AS INTEGER) AS n_rows, true AS same FROM scalars""")
def verdict_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices to JSON, nulls included: what the text says, and that it gives the invoice back."""
    r = derived.readings(spark, sf_dir).select("invoice_id", "a", dataset.to_json(F.col("a")).alias("json"))
    said = lambda f: F.get_json_object("json", f"$.{f}")
    back = dataset.invoice_from_json(F.col("json"))
    untaxed = F.contains(F.col("json"), F.lit('"tax":null'))
    return r.select("invoice_id", said("invoice_number").alias("number"), said("date").alias("date"), said("subtotal").cast(MONEY).alias("subtotal"), untaxed.alias("untaxed"), F.size(back["line_items"]).alias("n_rows"), back.eqNullSafe(F.col("a")).alias("same"))


@query()
def result_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV, JSON and HTML document of every verified invoice, by length."""
    docs = exports.documents(V.verify(derived.readings(spark, sf_dir)))
    sizes = docs.select("invoice_id", *[F.char_length(c).alias(c) for c in ("csv", "json", "html")])
    return sizes.select("invoice_id", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in ("csv", "json", "html")])).alias("d")).select("invoice_id", "d.kind", "d.n")


@query()
def field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.field_table(V.verify(derived.readings(spark, sf_dir)))


@query(f"""WITH {ITEMS_SQL} SELECT invoice_id, CAST(idx // 3 AS INTEGER) AS line_no, string_agg(CAST(idx AS VARCHAR), '  ' ORDER BY idx) AS line FROM items GROUP BY 1, 2""")
def box_row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes three to a row, shuffled and slightly tilted, back to lines."""
    i = F.col("idx")
    top = (F.floor(i / 3) * 40 + i % 3).cast("double")
    left = ((i % 3) * 100).cast("double")
    corner = lambda x, y: F.array(x, y)
    box = F.struct(F.array(corner(left, top), corner(left + 90, top), corner(left + 90, top + 20), corner(left, top + 20)).alias("bbox"), i.cast("string").alias("text"), F.lit(0.9).cast("double").alias("conf"))
    faint = F.struct(F.array(corner(left, top), corner(left + 90, top + 20)).alias("bbox"), F.lit("noise").alias("text"), F.lit(0.1).cast("double").alias("conf"))
    rows = derived.items(spark, sf_dir).select("invoice_id", F.explode(F.array(box, faint)).alias("box"), F.xxhash64("invoice_id", "idx").alias("mix"))
    boxes = rows.groupBy("invoice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("mix", "box"))), lambda x: x["box"]).alias("boxes"))
    return boxes.select("invoice_id", F.posexplode(L.lines_from_boxes(F.col("boxes"))).alias("line_no", "line"))


@query(f"""WITH {ITEMS_SQL},
r AS (SELECT invoice_id, idx, quantity, line_total, lead(line_total) OVER w AS next_total, lag(line_total) OVER w AS previous_total FROM items WINDOW w AS (PARTITION BY invoice_id ORDER BY idx))
SELECT * FROM r""")
def line_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and the previous line."""
    w = Window.partitionBy("invoice_id").orderBy("idx")
    return derived.items(spark, sf_dir).select("invoice_id", "idx", "quantity", "line_total", F.lead("line_total").over(w).alias("next_total"), F.lag("line_total").over(w).alias("previous_total"))


@query(f"""WITH {ITEMS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_total DESC, idx) AS k FROM items)
SELECT invoice_id, CAST(k AS INTEGER) AS k, idx, line_total FROM r WHERE k <= 3""")
def top_three_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three a group, the cut that hints have."""
    w = Window.partitionBy("invoice_id").orderBy(F.desc("line_total"), "idx")
    return derived.items(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 3").select("invoice_id", "k", "idx", "line_total")


_CULPRIT_SQL = f"""WITH {SCALARS_SQL},
h AS (SELECT invoice_id, a_number, a_date, true_total AS subtotal, a_total AS total FROM scalars WHERE mode = 'corrupted' AND a_tax IS NULL),
p AS (SELECT invoice_id, f.field, CAST(f.old AS VARCHAR) AS s, f.goal, p FROM h, LATERAL (VALUES ('subtotal', subtotal, total), ('total', total, subtotal)) f(field, old, goal), range(1, 30) t(p) WHERE p <= length(CAST(f.old AS VARCHAR))),
t AS (SELECT DISTINCT invoice_id, field FROM p JOIN {_ALTERNATES_SQL} ON digit = substr(s, p, 1) WHERE TRY_CAST(substr(s, 1, p - 1) || other || substr(s, p + 1) AS DECIMAL(18,2)) = goal),
c AS (SELECT h.invoice_id, a_number, a_date, CASE WHEN count(t.field) = 1 THEN min(t.field) END AS culprit FROM h LEFT JOIN t ON t.invoice_id = h.invoice_id GROUP BY ALL),
r AS (SELECT invoice_id, CASE WHEN a_number IS NULL THEN 2 ELSE 0 END AS number, CASE WHEN a_date = '31-02-2025' THEN 2 ELSE 0 END AS date,
             CASE WHEN culprit = 'subtotal' THEN 2 ELSE 1 END AS subtotal, CASE WHEN culprit = 'total' THEN 2 ELSE 1 END AS total FROM c)"""


def _untaxed_corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of one reading, without rows, of the invoices whose total is corrupted and that have no tax."""
    s = derived.scalars(spark, sf_dir).where((F.col("mode") == "corrupted") & F.col("a_tax").isNull())
    invoice = F.struct(F.col("a_number").alias("invoice_number"), F.col("a_date").alias("date"), F.array().cast(INVOICE["line_items"].dataType).alias("line_items"), F.col("true_total").alias("subtotal"), F.col("a_tax").alias("tax"), F.col("a_total").alias("total")).cast(INVOICE)
    return V.verify(s.select("invoice_id", invoice.alias("a"), F.lit(None).cast(INVOICE).alias("b")))


@query(_CULPRIT_SQL + """
SELECT invoice_id, CASE subtotal WHEN 2 THEN 'red' ELSE 'amber' END AS subtotal, CASE total WHEN 2 THEN 'red' ELSE 'amber' END AS total FROM r""")
def red_culprits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field that all repairs name is red, the others that are involved amber."""
    status = lambda f: F.get(F.filter("scalar_verdicts", lambda v: v["field"] == f), F.lit(0))["status"]
    return _untaxed_corrupted(spark, sf_dir).select("invoice_id", status("subtotal").alias("subtotal"), status("total").alias("total"))


@query(_CULPRIT_SQL + """
SELECT invoice_id, CASE greatest(number, date, total) WHEN 2 THEN 'red' ELSE 'amber' END AS report, CASE greatest(number, date, subtotal, total, 1) WHEN 2 THEN 'red' ELSE 'amber' END AS screen FROM r""")
def overall_report_and_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of number, date and total, and the worst of all fields and the rows."""
    return _untaxed_corrupted(spark, sf_dir).select("invoice_id", V.overall_worst(F.col("verdicts"), V.REPORT_FIELDS).alias("report"), V.overall_worst(F.col("verdicts"), V.SCREEN_FIELDS).alias("screen"))


@query(f"""WITH {ITEMS_SQL},
r AS (SELECT *, invoice_id % 3 = 0 AND idx % 2 = 1 AS off, (invoice_id + idx) % 4 = 0 AS lacks FROM items),
p AS (SELECT invoice_id, idx, part, off, lacks FROM r, (VALUES ('description'), ('quantity'), ('unit_price'), ('line_total')) t(part))
SELECT invoice_id, idx, part, CASE WHEN part = 'description' THEN 'green' WHEN lacks OR off AND part = 'quantity' THEN 'amber' ELSE 'green' END AS status FROM p""")
def row_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict a part of every row, by place: B misreads some quantities, and some rows lack their total in both readings."""
    rows = derived.items(spark, sf_dir)
    lacks = (F.col("invoice_id") + F.col("idx")) % 4 == 0
    total = F.when(~lacks, F.col("line_total"))
    off = (F.col("invoice_id") % 3 == 0) & (F.col("idx") % 2 == 1)
    side = lambda q: F.struct("idx", F.struct("description", q.alias("quantity"), "unit_price", total.alias("line_total")).cast(LINE_ITEM).alias("x"))
    both = rows.groupBy("invoice_id").agg(F.array_sort(F.collect_list(side(F.col("quantity")))).alias("a"), F.array_sort(F.collect_list(side(F.when(off, F.col("quantity") + 1).otherwise(F.col("quantity"))))).alias("b"))
    invoice = lambda c: F.struct(F.lit("INV-1").alias("invoice_number"), F.lit("2024-01-01").alias("date"), F.transform(c, lambda r: r["x"]).alias("line_items"), *[F.lit(None).alias(f) for f in ("subtotal", "tax", "total")]).cast(INVOICE)
    verdicts = V.verdict_rows(V.verify(both.select("invoice_id", invoice("a").alias("a"), invoice("b").alias("b"))))
    return verdicts.where(F.col("part").isNotNull()).select("invoice_id", "idx", "part", "status")


@query(f"""WITH {TOTALS_SQL},
h AS (SELECT invoice_id, subtotal, printed_total AS total FROM totals WHERE mode = 'corrupted' AND tax IS NULL),
p AS (SELECT invoice_id, f.field, CAST(f.old AS VARCHAR) AS s, f.old, f.goal, p FROM h, LATERAL (VALUES ('subtotal', subtotal, total), ('total', total, subtotal)) f(field, old, goal), range(1, 30) t(p) WHERE p <= length(CAST(f.old AS VARCHAR))),
t AS (SELECT DISTINCT invoice_id, field FROM p JOIN {_ALTERNATES_SQL} ON digit = substr(s, p, 1) WHERE TRY_CAST(substr(s, 1, p - 1) || other || substr(s, p + 1) AS DECIMAL(18,2)) = goal)
SELECT h.invoice_id, CASE WHEN count(t.field) = 1 THEN min(t.field) END AS culprit FROM h LEFT JOIN t ON t.invoice_id = h.invoice_id GROUP BY h.invoice_id""")
def unique_culprit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one field that all hints name."""
    broken = derived.totals(spark, sf_dir).where((F.col("mode") == "corrupted") & F.col("tax").isNull())
    hints = first_hints([hints_for(F.lit("subtotal"), F.col("subtotal"), lambda v: X.money_equal(v, "printed_total")), hints_for(F.lit("total"), F.col("printed_total"), lambda v: X.money_equal("subtotal", v))])
    return broken.select("invoice_id", hints.alias("hints")).select("invoice_id", culprit(F.col("hints")).alias("culprit"))
