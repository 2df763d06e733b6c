"""Properties of localisation, folding and plans."""

from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions.text import money_equal
from ledgerline.operators.extract import extract
from ledgerline.operators.localize import culprit, first_hints, hints_for
from ledgerline.operators.verify import Check, fold
from ledgerline.schemas import BASE_CONFIDENCE, STATUSES, alternates

money = st.decimals(min_value=0, max_value=99_999, places=2)
quick = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def brute_hints(fields, holds):
    out = []
    for name, value in fields:
        text = f"{value:.2f}"
        for k, digit in enumerate(text):
            if digit.isdigit() and len(out) < 3:
                for other in alternates().get(digit, []):
                    new = D(text[:k] + other + text[k + 1 :])
                    if new != value and holds(name, new):
                        out.append((name, value, new))
                        break
    return out


@quick
@given(st.lists(st.tuples(money, st.integers(0, 9), st.integers(0, 6)), min_size=1, max_size=12))
def test_hints_are_those_of_a_search(spark, cases):
    rows = []
    for k, (value, digit, place) in enumerate(cases):
        text = f"{value:.2f}"
        place = min(place, len(text) - 1)
        wrong = text if text[place] == "." else text[:place] + str(digit) + text[place + 1 :]
        rows.append((k, value, D(wrong)))
    df = spark.createDataFrame(rows, "id int, subtotal decimal(18,2), total decimal(18,2)")
    hints = first_hints([hints_for(F.lit("subtotal"), F.col("subtotal"), lambda v: money_equal(v, "total")), hints_for(F.lit("total"), F.col("total"), lambda v: money_equal("subtotal", v))])
    for r in df.select("*", hints.alias("h")).withColumn("c", culprit(F.col("h"))).collect():
        want = brute_hints([("subtotal", r["subtotal"]), ("total", r["total"])], lambda name, new: new == (r["total"] if name == "subtotal" else r["subtotal"]))
        assert [tuple(h) for h in r["h"]] == want
        assert r["c"] == (want[0][0] if len({w[0] for w in want}) == 1 else None)


@quick
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 2), st.sampled_from("abc"), st.sampled_from([0.1, 1.0])), min_size=1, max_size=6))
def test_folds_take_the_worst(spark, checks):
    made = [Check(F.lit(when), rank, reason, cap) for when, rank, reason, cap in checks]
    for order in (made, made[::-1]):
        got = spark.range(1).select(fold(order).alias("f")).first()["f"]
        held = [c for c in checks if c[0]]
        rank = max((c[1] for c in held), default=0)
        assert got["rank"] == rank
        assert got["confidence"] == min([BASE_CONFIDENCE[STATUSES[rank]], *(c[3] for c in held)])
        reasons = list(dict.fromkeys(c[2] for c in (held if order is made else held[::-1])))
        assert got["reasons"] == reasons


def test_extraction_is_one_narrow_plan(spark):
    df = extract(spark.createDataFrame([(1, ["Total: 5"])], "invoice_id int, lines array<string>"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Generate" not in plan
