"""Queries without SQL against plain Python on the small tables."""

import csv
import io
import json
import re
import unicodedata
from collections import defaultdict
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry
from ledgerline.functions import text as X
from ledgerline.plans import derived
from ledgerline.schemas import BASE_CONFIDENCE, PARTS, SCALARS, STATUSES, alternates

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def cents(v):
    return v.quantize(Decimal("0.01"), ROUND_HALF_UP)


def same(a, b):
    return cents(a) == cents(b)


def repairs(key, value, holds):
    out, printed = [], str(cents(value))
    for k, digit in enumerate(printed):
        tried = [Decimal(printed[:k] + d + printed[k + 1 :]) for d in alternates().get(digit, [])]
        out += [(key, cents(value), v) for v in tried if v != value and holds(v)][:1]
    return out


class Field:
    def __init__(self):
        self.rank, self.cap, self.reasons, self.hints = 0, 1.0, [], []

    def add(self, rank, reason, cap=1.0, hints=()):
        self.rank, self.cap = max(self.rank, rank), min(self.cap, cap)
        self.reasons += [reason] if reason not in self.reasons else []
        self.hints += [h for h in hints if h not in self.hints]

    def violated(self, key, reason, hints):
        if hints is not None:
            self.add(1, reason, hints=hints)
            if {h[0] for h in hints} == {key}:
                self.add(2, "CULPRIT")

    def compare(self, a, b, numeric):
        agree = same(a, b) if numeric else a == b
        self.add(0 if agree else 1, "ENGINES_AGREE" if agree else "ENGINE_DIFF")

    def out(self):
        return STATUSES[self.rank], round(min(BASE_CONFIDENCE[STATUSES[self.rank]], self.cap), 2), self.reasons or ["ENGINES_AGREE_CHECKS_PASS"], self.hints


def real_day(text):
    try:
        return bool(datetime.strptime(text, "%Y-%m-%d"))
    except ValueError:
        return False


def expected(a, b):
    """Verdicts of two readings whose rows are whole and of which A has no fewer."""
    items, others = a["line_items"], b["line_items"]
    m = {f: a[f] if a[f] is not None else b[f] for f in SCALARS}
    rows, tax = sum(x["line_total"] for x in items), m["tax"] or Decimal(0)
    subtotal, total = m["subtotal"], m["total"]
    key = "line_items[{}].{}".format
    sums = totals = None
    if subtotal is not None and not same(rows, subtotal):
        sums = [h for i, x in enumerate(items) for h in repairs(key(i, "line_total"), x["line_total"], lambda v, x=x: same(rows - x["line_total"] + v, subtotal))]
        sums = (sums + repairs("subtotal", subtotal, lambda v: same(rows, v)))[:3]
    if subtotal is not None and total is not None and not same(subtotal + tax, total):
        totals = (repairs("subtotal", subtotal, lambda v: same(v, total)) + repairs("total", total, lambda v: same(subtotal, v)))[:3]
    fields = {}
    for f in SCALARS:
        x = fields[f] = Field()
        if a[f] is None and b[f] is None:
            x.add(*((2, "MISSING_REQUIRED", 0.1) if f in ("invoice_number", "date", "total") else (1, "MISSING_OPTIONAL")))
        elif a[f] is None or b[f] is None:
            x.add(1, "A_ONLY" if b[f] is None else "B_ONLY")
        else:
            x.compare(a[f], b[f], f not in ("invoice_number", "date"))
        if f == "date" and m[f] is not None and not real_day(m[f]):
            x.add(2, "BAD_DATE", 0.1)
        if f == "invoice_number" and m[f] is not None and not re.fullmatch(r"\S{2,30}", m[f]):
            x.add(2, "BAD_FORMAT")
    fields["subtotal"].violated("subtotal", "SUM_ARITHMETIC", sums)
    if subtotal is None:
        fields["subtotal"].add(1, "SUBTOTAL_MISSING")
    fields["subtotal"].violated("subtotal", "TOTAL_ARITHMETIC", totals)
    fields["total"].violated("total", "TOTAL_ARITHMETIC", totals)
    if total is not None and subtotal is None and not same(rows + tax, total):
        fields["total"].add(1, "TOTAL_UNSUPPORTED")
    if m["tax"] is None and fields["subtotal"].rank == fields["total"].rank == 0 and same(subtotal, total):
        fields["tax"] = Field()
        fields["tax"].add(0, "NO_TAX_CONFIRMED", 0.8)
    worst = 0
    for i, x in enumerate(items):
        q, p, t = x["quantity"], x["unit_price"], x["line_total"]
        broken = None
        if not same(q * p, t):
            broken = repairs(key(i, "quantity"), q, lambda v: same(v * p, t)) + repairs(key(i, "unit_price"), p, lambda v: same(q * v, t)) + repairs(key(i, "line_total"), t, lambda v: same(q * p, v))
            broken = broken[:3]
        for part in PARTS:
            y = fields[key(i, part)] = Field()
            if i >= len(others):
                y.add(1, "NOT_READ_BY_B")
            else:
                y.compare(x[part], others[i][part], part != "description")
            if part != "description":
                y.violated(key(i, part), "LINE_ARITHMETIC", broken)
            if part == "line_total":
                y.violated(key(i, part), "SUM_ARITHMETIC", sums)
            worst = max(worst, y.rank)
    out = {f: x.out() for f, x in fields.items()}
    uneven = len(items) != len(others)
    reached = 2 if uneven else worst
    out["line_items"] = (STATUSES[reached if uneven else 0], BASE_CONFIDENCE[STATUSES[reached]], ["ROW_COUNT_DIFFERS" if uneven else "ENGINES_AGREE_CHECKS_PASS"], [])
    return out


@pytest.fixture(scope="module")
def verdicts(spark):
    return entry.queries()["verify_end_to_end"](spark, str(DATA)).collect()


def test_verify_end_to_end(spark, verdicts):
    got = defaultdict(dict)
    for r in verdicts:
        kinds = list(dict.fromkeys(x.split(" ")[0].rstrip(":") for x in r["reasons"]))
        got[r["invoice_id"]][r["field"]] = (r["status"], r["confidence"], kinds, [tuple(h) for h in r["hints"]])
    want = {r["invoice_id"]: expected(r["a"].asDict(), r["b"].asDict()) for r in derived.readings(spark, str(DATA)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
    assert {s for v in want.values() for s, *_ in v.values()} == set(STATUSES)
    assert any(v[3] for w in want.values() for v in w.values())


def test_exports(spark, verdicts):
    def shown(v):
        if v["value_text"] is not None:
            return v["value_text"]
        if v["value_number"] is None:
            return "—"
        return str(int(v["value_number"])) if v["field"] == "line_items" else f"{cents(v['value_number']):,.2f}"

    want = defaultdict(list)
    for v in sorted(verdicts, key=lambda v: (v["field_ord"] == 99, v["field_ord"] >= 10, v["idx"] or 0, v["field_ord"])):
        want[v["invoice_id"]].append((v["field"], v["status"], shown(v), "; ".join(v["reasons"])))
    table = defaultdict(list)
    for r in sorted(entry.queries()["field_table"](spark, str(DATA)).collect(), key=lambda r: r["ord"]):
        table[r["invoice_id"]].append((r["field"], r["status"], r["value"], r["reasons"]))
    assert table == want
    sizes = {(r["invoice_id"], r["kind"]): r["n"] for r in entry.queries()["result_exports"](spark, str(DATA)).collect()}
    header = ("field", "status", "value", "reasons")
    for k, rows in want.items():
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([header, *rows])
        assert sizes[k, "csv"] == 1 + len(text.getvalue())
        assert sizes[k, "json"] == len(json.dumps([dict(zip(header, r)) for r in rows], ensure_ascii=False, separators=(",", ":")))
        assert sizes[k, "html"] > sum(len(v) for r in rows for v in r)


def test_normalize_text_docs(spark):
    swaps = str.maketrans(X._FROM[: len(X._TO)], X._TO, X._FROM[len(X._TO) :])
    want = {r["doc_id"]: re.sub("[ \t\xa0]+", " ", unicodedata.normalize("NFKC", r["text"] or "").translate(swaps)).strip() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"]: r["clean"] for r in entry.queries()["normalize_text_docs"](spark, str(DATA)).collect()} == want
