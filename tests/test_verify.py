from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import verify as V
from ledgerline.schemas import INVOICE, alternates

ROWS = [("rice", D(3), D(140), D(420)), ("oil", D(20), D(210), D(4200))]
WRONG = [ROWS[0], ("oil", D(20), D(210), D(4201))]
PAIRS = T.StructType([T.StructField("invoice_id", T.IntegerType()), T.StructField("a", INVOICE), T.StructField("b", INVOICE)])


def invoice(**changes):
    base = {"invoice_number": "INV-2024-0317", "date": "2024-03-09", "line_items": ROWS, "subtotal": D(4620), "tax": D(462), "total": D(5082)}
    return tuple((base | changes).values())


CASES = {
    "agree": (invoice(), invoice(), {f: ("green", 0.9) for f in V.SCREEN_FIELDS}),
    "row total": (invoice(line_items=WRONG), invoice(line_items=WRONG), {"line_items[1].line_total": ("red", 0.25), "line_items[1].quantity": ("amber", 0.5), "subtotal": ("amber", 0.5), "line_items": ("green", 0.25)}),
    "total differs": (invoice(), invoice(total=D(5092)), {"total": ("amber", 0.5)}),
    "only A": (invoice(), invoice(total=None), {"total": ("amber", 0.5)}),
    "only B": (invoice(total=None), invoice(), {"total": ("amber", 0.5)}),
    "no number": (invoice(invoice_number=None), invoice(invoice_number=None), {"invoice_number": ("red", 0.1)}),
    "bad date": (invoice(date="30-02-2024"), invoice(date="30-02-2024"), {"date": ("red", 0.1)}),
    "negative": (invoice(total=D(-500), subtotal=None), invoice(total=D(-500), subtotal=None), {"total": ("red", 0.1)}),
    "row count": (invoice(), invoice(line_items=ROWS[:1], subtotal=None, tax=None, total=None), {"line_items": ("red", 0.25), "line_items[1].quantity": ("amber", 0.5)}),
    "B longer": (invoice(line_items=ROWS[:1]), invoice(), {"line_items": ("red", 0.25), "line_items[1].quantity": ("green", 0.9)}),
    "single": (invoice(line_items=WRONG), None, {"total": ("green", 0.9), "line_items[1].line_total": ("red", 0.25)}),
    "number differs": (invoice(), invoice(invoice_number="INV-2024-0318"), {"invoice_number": ("amber", 0.5)}),
    "bad number": (invoice(invoice_number="a b"), None, {"invoice_number": ("red", 0.25)}),
    "subtotal missing": (invoice(subtotal=None, total=D(5200)), invoice(subtotal=None, total=D(5200)), {"subtotal": ("amber", 0.5), "total": ("amber", 0.5)}),
    "no tax": (invoice(tax=None, total=D(4620)), invoice(tax=None, total=D(4620)), {"tax": ("green", 0.8), "total": ("green", 0.9)}),
    "tax open": (invoice(tax=None, subtotal=None), invoice(tax=None, subtotal=None), {"tax": ("amber", 0.5), "subtotal": ("amber", 0.5)}),
    "tax breaks": (invoice(tax=None), invoice(tax=None), {"tax": ("amber", 0.5), "subtotal": ("amber", 0.5), "total": ("amber", 0.5)}),
    "no rows": (invoice(line_items=[]), invoice(line_items=[]), {"line_items": ("amber", 0.5)}),
    "null rows": (invoice(line_items=None), None, {"line_items": ("amber", 0.5)}),
    "incomplete": (invoice(line_items=[("x", None, D(150), D(300)), ROWS[1]]), None, {"line_items[0].unit_price": ("amber", 0.5), "line_items[0].quantity": ("green", 0.9)}),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(CASES.values())], PAIRS)
    rows = V.verdict_rows(V.verify(df)).collect()
    names = list(CASES)
    return {n: {r["field"]: r for r in rows if names[r["invoice_id"]] == n} for n in names}


@pytest.mark.parametrize("name", CASES)
def test_verdicts(verdicts, name):
    for field, want in CASES[name][2].items():
        got = verdicts[name][field]
        assert (got["status"], got["confidence"]) == want, (field, got)
        assert got["reasons"]


def test_hints_name_the_repair_and_change_nothing(verdicts):
    got = verdicts["row total"]["line_items[1].line_total"]
    assert ("line_items[1].line_total", D("4201.00"), D("4200.00")) in [tuple(h) for h in got["hints"]]
    assert got["value_number"] == D(4201)
    assert len(got["reasons"]) == len(set(got["reasons"]))


def test_order_of_verdicts(spark):
    df = spark.createDataFrame([(0, invoice(), None)], PAIRS)
    fields = [v["field"] for v in V.verify(df).first()["verdicts"]]
    assert fields[:5] == list(V.SCALARS) and fields[5] == "line_items[0].description" and fields[-1] == "line_items"


def test_single_reading_of_b_is_promoted(spark):
    one = spark.createDataFrame([(1, invoice())], T.StructType([PAIRS[0], T.StructField("invoice", INVOICE)]))
    pair = V.pair_readings(one.limit(0), one).first()
    assert pair["a"]["total"] == D(5082) and pair["b"] is None


def test_overall(spark):
    df = V.verify(spark.createDataFrame([(0, invoice(tax=None), None)], PAIRS))
    row = df.select(V.overall_worst(F.col("verdicts"), ("invoice_number", "date")).alias("x"), V.overall_worst(F.col("verdicts"), V.SCREEN_FIELDS).alias("y")).first()
    assert (row["x"], row["y"]) == ("green", "amber")


def test_confusions_are_symmetric():
    found = alternates()
    assert sum(map(len, found.values())) == 30
    assert all(a in found[b] for a, others in found.items() for b in others)


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = V.verify(spark.createDataFrame([(0, invoice(), None)], PAIRS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def _amounts():
    import random

    mix = random.Random(7)
    shapes = [lambda: D(mix.randrange(1, 10**6)) / 100, lambda: D(mix.randrange(-(10**5), 10**5)) / 10000, lambda: D(mix.randrange(10**16)), lambda: D(10**32 - 1), lambda: D(mix.choice([0, 1, 5, 6, 8, 9])), lambda: D(mix.randrange(10**7)) / 1000]
    digit = alternates()
    for k in range(1200):
        q, p = mix.choice(shapes)(), mix.choice(shapes)()
        three = [q, p, (q * p).quantize(D("0.01")) if abs(q * p) < 10**24 else mix.choice(shapes)()]
        n = mix.randrange(3)
        printed = f"{three[n]:.2f}"
        at = mix.choice([i for i, c in enumerate(printed) if c in digit])
        if k % 5 and abs(three[n]) < 10**30:
            three[n] = D(printed[:at] + mix.choice(digit[printed[at]]) + printed[at + 1 :])
        if abs(three[2]) < 10**34:
            yield (k, *three)


def test_narrowed_repairs_are_those_of_the_whole_search(spark):
    """Products, sums and totals: digits that can't close a constraint are left out, and no repair is lost."""
    from ledgerline.functions.text import money_equal, plus, product_cents
    from ledgerline.operators.localize import first_hints, hints_for

    df = spark.createDataFrame(list(_amounts()), "k int, q decimal(38,4), p decimal(38,4), t decimal(38,4)").repartition(4)
    q, p, t = F.col("q"), F.col("p"), F.col("t")
    item = F.struct(F.lit("x").alias("description"), q.alias("quantity"), p.alias("unit_price"), t.alias("line_total"))
    key = lambda part: F.lit(f"line_items[0].{part}")
    whole = first_hints([hints_for(key("quantity"), q, lambda v: money_equal(product_cents(v, p), t)), hints_for(key("unit_price"), p, lambda v: money_equal(product_cents(q, v), t)), hints_for(key("line_total"), t, lambda v: money_equal(product_cents(q, p), v))])
    m = F.struct(F.array(item).alias("line_items"), q.alias("subtotal"), F.lit(None).cast("decimal(38,4)").alias("tax"), p.alias("total"))
    sums = first_hints([hints_for(key("line_total"), t, lambda v: money_equal(plus(F.try_subtract(t, t), v), q)), hints_for(F.lit("subtotal"), q, lambda v: money_equal(t, v))])
    totals = first_hints([hints_for(F.lit("subtotal"), q, lambda v: money_equal(v, p)), hints_for(F.lit("total"), p, lambda v: money_equal(q, v))])
    got = df.select("k", V.product_hints(F.array(item))[0].alias("product"), whole.alias("whole"), V.sum_hints(m, t).alias("sum"), sums.alias("sums"), V.total_hints(m).alias("total"), totals.alias("totals")).collect()
    found = 0
    for r in got:
        for narrow, full in (("product", "whole"), ("sum", "sums"), ("total", "totals")):
            assert r[narrow] is None or r[narrow] == r[full], r
            found += bool(r[narrow])
    assert found > 300


def test_hopeless_repairs_are_not_tried(spark):
    """Of a number of 32 digits that is far too large only the leading places are searched, and none if no digit fits."""
    from ledgerline.operators.localize import _places, _reaches

    off = lambda v: F.lit(v).cast("double")
    places = lambda v: _places(F.lit(35), off(v), off(0.03))
    row = spark.range(1).select(places(-1e32).alias("far"), places(0.6).alias("near"), places(None).alias("all"), _reaches(off(0.6), off(0.03)).alias("some"), _reaches(off(1234.5), off(0.03)).alias("none")).first()
    assert len(row["far"]) <= 2 and row["near"] == [34] and len(row["all"]) == 35
    assert (row["some"], row["none"]) == (True, False)


def test_large_numbers_use_all_cores(spark):
    import __spark_entry__ as entry

    assert entry.queries()["large_numbers"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
