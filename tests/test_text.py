from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import text as X


def apply(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given_text", "want"),
    [("۹۸۷۶", "9876"), ("٠١٢٣", "0123"), ("۷،۸", "7,8"), ("۳۱۔", "31."), ("۲٫۷۵", "2.75"), ("۲٬۵۰۰", "2500"), ("كي", "کی"), ("“a” ‘b’", "\"a\" 'b'"), ("  a \t b\xa0 ", "a b"), (None, ""), ("", "")],
)
def test_normalize_digits(spark, given_text, want):
    assert apply(spark, X.normalize_digits, given_text) == want


@pytest.mark.parametrize(("given_text", "want"), [("رقـ‌م", "رقم"), ("﻿تِل‍", "تِل"), ("ﬁ Ⅳ", "fi IV"), ("رقم  77 \t- 5", "رقم 77 - 5"), (" x\x1c", "x")])
def test_normalize_text(spark, given_text, want):
    assert apply(spark, X.normalize_text, given_text) == want


@pytest.mark.parametrize(("given_text", "want"), [("2,640.75", "2640.75"), ("۳۱۵", "315"), ("PKR 9,100", "9100"), ("کل ۴۲۰", "420"), ("-5", "-5"), ("", None), (None, None), ("none", None)])
def test_parse_amount(spark, given_text, want):
    assert apply(spark, X.parse_amount, given_text) == (None if want is None else Decimal(want))


@pytest.mark.parametrize(
    ("given_text", "want"),
    [("09-03-2024", date(2024, 3, 9)), ("2024/03/09", date(2024, 3, 9)), ("۰۹-۰۳-۲۰۲۴", date(2024, 3, 9)), ("2025 1 9", date(2025, 1, 9)), ("1.2.2024 x", date(2024, 2, 1)), ("30-02-2024", None), ("0000-01-01", None), ("no day", None), (None, None)],
)
def test_parse_date(spark, given_text, want):
    assert apply(spark, X.parse_date, given_text) == want
    assert apply(spark, X.iso_date, given_text) == (want.isoformat() if want else None)


@pytest.mark.parametrize(("a", "b", "limit", "want"), [("", "four", None, 4), ("ledger", "lodged", None, 2), ("ledger", "lodged", 2, 2), ("ink", "pot", 1, 2), ("line", "line", 0, 0), ("i", "invoices", 2, 3)])
def test_edit_distance(spark, a, b, limit, want):
    assert apply(spark, lambda x, y: X.edit_distance(x, y, limit), a, b) == want


@pytest.mark.parametrize(("a", "b", "want"), [("۴۵۶", "456", 1.0), ("", "", 1.0), (None, "", 1.0), ("row", "", 0.0), ("rows", "rowd", 0.75)])
def test_similarity(spark, a, b, want):
    assert apply(spark, X.similarity, a, b) == want


@pytest.mark.parametrize(("value", "printed", "shown"), [("1234", "1,234", "1,234.00"), ("1234.5", "1,234.50", "1,234.50"), ("0.25", "0.25", "0.25"), (None, None, "—")])
def test_amounts_as_printed(spark, value, printed, shown):
    assert apply(spark, lambda c: X.grouped(c.cast("decimal(18,4)")), value) == printed
    assert apply(spark, lambda c: X.shown(c.cast("decimal(18,4)")), value) == shown


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=30))
def test_normalizing_twice_changes_nothing(spark, value):
    once = apply(spark, X.normalize_text, value)
    assert apply(spark, X.normalize_text, once) == once
