"""Two readings of a document to one verdict a field.

A field has a list of checks (where it applies, rank, reason, confidence cap, hints);
its verdict is a fold over them.  Both are expressions on the document's row: pairing
the readings is the only shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cents, let, money_equal, parse_date, plus, product_cents, similarity
from ..schemas import AMOUNT, BASE_CONFIDENCE, CERTAIN_RED_CONFIDENCE, LINE_ITEM, NO_TAX_CONFIDENCE, NUMERIC, PARTS, REQUIRED, SCALARS, STATUSES
from .localize import HINT_TYPE, culprit, first_hints, hints_for

#: More than the cent rounding of three amounts, and than the relative error of a few steps on doubles.
_CENT_GIVE, _DOUBLE_GIVE = 0.03, 1e-12

VERDICT_COLUMNS = ["field", "field_ord", "idx", "part", "value_text", "value_number", "status", "rank", "confidence", "reasons", "hints"]


def pair_readings(first: DataFrame, second: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Full outer pairing; a document that only the second engine read is promoted to single-engine."""
    a = first.select(key, F.col("invoice").alias("a"))
    b = second.select(key, F.col("invoice").alias("b"))
    both = a.join(b, key, "full")
    return both.select(key, F.coalesce("a", "b").alias("a"), F.when(F.col("a").isNotNull(), F.col("b")).alias("b"))


def agreement(name: str, va: Column, vb: Column, numeric: bool) -> tuple[Column, Column]:
    """(rank, reason) of two values that are both there."""
    shown = lambda v: v.cast("string")
    if numeric:
        same = money_equal(va, vb)
        differ = F.concat(F.lit(f"ENGINE_DIFF {name}: A="), shown(cents(va)), F.lit(", B="), shown(cents(vb)))
    else:
        same = va.eqNullSafe(vb)
        near = F.round(similarity(va, vb), 2)
        differ = F.concat(F.lit(f"ENGINE_DIFF {name}: similarity "), F.format_string("%.2f", near), F.lit(", A="), F.coalesce(va, F.lit("")), F.lit(", B="), F.coalesce(vb, F.lit("")))
    return F.when(same, 0).otherwise(1), F.when(same, F.lit(f"ENGINES_AGREE {name}")).otherwise(differ)


def _lit(v: object) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


@dataclass
class Check:
    """A test of one field: where it applies, how bad that is, and why."""

    when: Column
    rank: Column | int
    reason: Column | str
    cap: float = 1.0
    hints: Column | None = None


def _part_key(i: Column, part: str) -> Column:
    return F.concat(F.lit("line_items["), i.cast("string"), F.lit(f"].{part}"))


def _violation(when: Column, key: Column | str, reason: str, hints: Column, only: Column | None = None) -> list[Check]:
    """A field that is involved turns amber and has the hints; the unique culprit (``only``, if it is known) turns red."""
    return [Check(when, 1, reason, hints=hints), Check(when & ((culprit(hints) if only is None else only) == _lit(key)), 2, "CULPRIT: a single-digit correction closes the arithmetic")]


_NO_HINTS = f"array<{HINT_TYPE}>"


def fold(checks: list[Check]) -> Column:
    """rank, confidence, distinct reasons and hints of a field, from its checks in order.

    The rank is the worst, the confidence the least that a check allows.
    """
    return let(F.array(*[F.coalesce(c.when, F.lit(False)) for c in checks]), lambda applies: _folded([replace(c, when=F.get(applies, F.lit(k))) for k, c in enumerate(checks)]))


def _folded(checks: list[Check]) -> Column:
    ranks = [F.when(c.when, _lit(c.rank)).otherwise(0) for c in checks]
    rank = F.greatest(*ranks, F.lit(0))
    caps = [F.when(c.when, F.lit(c.cap)) for c in checks if c.cap < 1.0]
    base = F.element_at(F.array(*[F.lit(BASE_CONFIDENCE[s]) for s in STATUSES]), rank + 1)
    hints = [F.when(c.when, c.hints) for c in checks if c.hints is not None]
    none = F.array().cast(_NO_HINTS)
    return F.struct(
        rank.alias("rank"),
        F.least(base, *caps).alias("confidence") if caps else base.alias("confidence"),
        F.array_distinct(F.array_compact(F.array(*[F.when(c.when, _lit(c.reason)) for c in checks]))).alias("reasons"),
        (F.array_distinct(F.flatten(F.array_compact(F.array(*hints)))) if hints else none).alias("hints"),
    )


def _nothing_but(*reasons: str) -> Column:
    """The fold of checks of which none applies, or only one that gives a reason."""
    return F.struct(F.lit(0).alias("rank"), F.lit(BASE_CONFIDENCE[STATUSES[0]]).alias("confidence"), F.array(*map(F.lit, reasons)).cast("array<string>").alias("reasons"), F.array().cast(_NO_HINTS).alias("hints"))


def _judgement(f: Column, default: Column) -> Column:
    """What a verdict says of a fold; ``default`` is the reason if there is no other."""
    reasons = F.when(F.size(f["reasons"]) == 0, F.array(default)).otherwise(f["reasons"])
    status = F.element_at(F.array(*map(F.lit, STATUSES)), f["rank"] + 1)
    return F.struct(status.alias("status"), f["rank"].alias("rank"), F.round(f["confidence"], 2).alias("confidence"), reasons.alias("reasons"), f["hints"].alias("hints"))


def scalar_checks(f: str, a: Column, b: Column, single: Column) -> list[Check]:
    va, vb = a[f], b[f]
    neither = va.isNull() & vb.isNull()
    missing = Check(neither, 2, f"MISSING_REQUIRED {f}", CERTAIN_RED_CONFIDENCE) if f in REQUIRED else Check(neither, 1, f"MISSING_OPTIONAL {f}")
    rank, reason = agreement(f, va, vb, f in NUMERIC)
    return [
        missing,
        Check(~single & va.isNotNull() & vb.isNull(), 1, f"A_ONLY {f}"),
        Check(~single & va.isNull() & vb.isNotNull(), 1, f"B_ONLY {f}"),
        Check(~single & va.isNotNull() & vb.isNotNull(), rank, reason),
    ]


def part_checks(part: str, x: Column, y: Column, single: Column) -> list[Check]:
    """Agreement of one part of a row with the row at the same place of the other reading."""
    checks = [Check(~single & y.isNull(), 1, "NOT_READ_BY_B")]
    both = ~single & y.isNotNull()
    u, v = x[part], y[part]
    rank, reason = agreement(part, u, v, part != "description")
    if part == "description":
        return [*checks, Check(both, rank, reason)]
    return [
        *checks,
        Check(both & u.isNull() & v.isNull(), 1, f"MISSING_PART {part}"),
        Check(both & u.isNotNull() & v.isNull(), 1, f"A_ONLY {part}"),
        Check(both & u.isNull() & v.isNotNull(), 1, f"B_ONLY {part}"),
        Check(both & u.isNotNull() & v.isNotNull(), rank, reason),
    ]


def _bad_format(f: str, v: Column) -> Column:
    """No calendar day, no number of an invoice, or negative; of a value that is there."""
    if f == "date":
        return parse_date(v).isNull()
    if f == "invoice_number":
        return ~v.rlike(r"\A\S{2,30}\z")
    return v < 0


def format_checks(f: str, m: Column) -> list[Check]:
    v = m[f]
    bad = v.isNotNull() & _bad_format(f, v)
    if f == "date":
        return [Check(bad, 2, F.concat(F.lit("BAD_DATE "), v), CERTAIN_RED_CONFIDENCE)]
    if f == "invoice_number":
        return [Check(bad, 2, "BAD_FORMAT invoice_number")]
    return [Check(bad, 2, f"NEGATIVE {f}", CERTAIN_RED_CONFIDENCE)]


def _equal(a: Column, b: Column) -> Column:
    """Equal at cent precision; a side that is null or too large is equal to nothing."""
    return F.coalesce(money_equal(a, b), F.lit(False))


def broken_product(x: Column) -> Column:
    """All three parts are there, and quantity times price is not the total."""
    q, p, t = x["quantity"], x["unit_price"], x["line_total"]
    return q.isNotNull() & p.isNotNull() & t.isNotNull() & ~_equal(product_cents(q, p), t)


def _off(a: Column, b: Column) -> Column:
    """How far an amount is from one that closes a sum, for hints_for: every term may be rounded to cents."""
    off = F.try_subtract(a, b).cast("double")
    return F.struct(off.alias("off"), (_CENT_GIVE + _DOUBLE_GIVE * F.abs(off)).alias("give"))


def _quotient_off(value: Column, factor: Column, product: Column) -> Column:
    """How far a value is from those that times the factor give the product; null for a factor of nothing."""
    factor, value = factor.cast("double"), cents(value).cast("double")
    want = F.try_divide(product.cast("double"), factor)
    return F.struct((want - value).alias("off"), (F.try_divide(F.lit(_CENT_GIVE), F.abs(factor)) + _DOUBLE_GIVE * (F.abs(want) + F.abs(value))).alias("give"))


def product_hints(items: Column) -> Column:
    """Per row the repairs of quantity times price = total; null where it holds or a part is missing."""

    def at(x: Column, i: Column) -> Column:
        q, p, t = x["quantity"], x["unit_price"], x["line_total"]
        factor = lambda part, other, holds: let(_quotient_off(x[part], other, t), lambda d: hints_for(_part_key(i, part), x[part], holds, d["off"], d["give"]))
        total = lambda product: let(_off(product, t), lambda d: hints_for(_part_key(i, "line_total"), t, lambda v: money_equal(product, v), d["off"], d["give"]))
        hints = first_hints(
            [
                factor("quantity", p, lambda v: money_equal(product_cents(v, p), t)),
                factor("unit_price", q, lambda v: money_equal(product_cents(q, v), t)),
                let(product_cents(q, p), total),
            ]
        )
        return F.when(broken_product(x), hints)

    return F.transform(items, at)


def product_checks(part: str, x: Column, i: Column, hints: Column, only: Column | None = None) -> list[Check]:
    """quantity times price is the row's total, at cent precision."""
    present = [x[p].isNotNull() for p in PARTS[1:]]
    some, full = x[part].isNotNull() & ~(present[0] & present[1] & present[2]), hints.isNotNull()
    return [Check(some, 1, "ROW_INCOMPLETE"), *_violation(full, _part_key(i, part), "LINE_ARITHMETIC: quantity x unit_price differs from line_total", hints, only)]


def row_sum(items: Column) -> Column:
    """Sum of the row totals that are there; null if none is."""
    totals = F.filter(F.transform(items, lambda x: x["line_total"]), lambda t: t.isNotNull())
    return F.when(F.size(totals) > 0, F.aggregate(totals, F.lit(0).cast(AMOUNT), plus))


def sum_hints(m: Column, total: Column) -> Column:
    """The repairs of sum of row totals = subtotal; null where it holds or can't be checked."""
    subtotal = m["subtotal"]

    def repairs(d: Column) -> Column:
        per_row = F.flatten(F.transform(m["line_items"], lambda x, i: hints_for(_part_key(i, "line_total"), x["line_total"], lambda v: money_equal(plus(F.try_subtract(total, x["line_total"]), v), subtotal), d["off"], d["give"])))
        return first_hints([per_row, hints_for(F.lit("subtotal"), subtotal, lambda v: money_equal(total, v), d["off"], d["give"])])

    return F.when(total.isNotNull() & subtotal.isNotNull() & ~_equal(total, subtotal), let(_off(total, subtotal), repairs))


def total_hints(m: Column, include_tax: bool = False) -> Column:
    """The repairs of subtotal + tax = total; null where it holds or can't be checked.

    The repair search leaves the tax out, as the reference semantics do;
    ``include_tax`` puts it in.
    """
    subtotal, total, tax = m["subtotal"], m["total"], F.coalesce(m["tax"], F.lit(0).cast(AMOUNT))
    added = tax if include_tax else F.lit(0).cast(AMOUNT)

    def repairs(d: Column) -> Column:
        return first_hints(
            [
                hints_for(F.lit("subtotal"), subtotal, lambda v: money_equal(plus(v, added), total), d["off"], d["give"]),
                hints_for(F.lit("total"), total, lambda v: money_equal(plus(subtotal, added), v), d["off"], d["give"]),
            ]
        )

    return F.when(subtotal.isNotNull() & total.isNotNull() & ~_equal(plus(subtotal, tax), total), let(_off(plus(subtotal, added), total), repairs))


_SUM_REASON = "SUM_ARITHMETIC: row totals differ from subtotal"
_TOTAL_REASON = "TOTAL_ARITHMETIC: subtotal + tax differs from total"


def subtotal_checks(m: Column, rows: Column, sums: Column, totals: Column) -> list[Check]:
    """The row totals add up to the subtotal; subtotal and tax to the total."""
    return [*_violation(sums.isNotNull(), "subtotal", _SUM_REASON, sums), Check(rows.isNotNull() & m["subtotal"].isNull(), 1, "SUBTOTAL_MISSING"), *_violation(totals.isNotNull(), "subtotal", _TOTAL_REASON, totals)]


def total_checks(m: Column, rows: Column, totals: Column) -> list[Check]:
    """Subtotal and tax add up to the total; without a subtotal, rows and tax do."""
    tax = F.coalesce(m["tax"], F.lit(0).cast(AMOUNT))
    loose = m["total"].isNotNull() & m["subtotal"].isNull() & rows.isNotNull() & ~_equal(plus(rows, tax), m["total"])
    return [*_violation(totals.isNotNull(), "total", _TOTAL_REASON, totals), Check(loose, 1, "TOTAL_UNSUPPORTED: rows + tax differ from total")]


def verify(pairs: DataFrame, key: str = "invoice_id", include_tax: bool = False, compare_to_a: bool = False) -> DataFrame:
    """``merged``, ``verdicts`` (an ordered array) and ``scalar_verdicts`` (its first part) for each pair of readings a, b (b null: one engine).

    A plan that only takes ``scalar_verdicts`` never builds the rows'.

    When B has more rows, B's rows are the merged ones and are compared with
    themselves, as the reference semantics have it; ``compare_to_a`` compares them with A's.
    """
    empty = F.array().cast(f"array<{LINE_ITEM.simpleString()}>")
    a, b, single = F.col("a"), F.col("b"), F.col("b").isNull()
    rows_a, rows_b = F.coalesce(a["line_items"], empty), F.coalesce(b["line_items"], empty)
    longer = ~single & (F.size(rows_b) > F.size(rows_a))
    step = pairs.withColumns({"_items": F.when(longer, rows_b).otherwise(rows_a), "_other": F.when(longer & F.lit(compare_to_a), rows_a).otherwise(rows_b), "_single": single, "_uneven": ~single & (F.size(rows_a) != F.size(rows_b))})
    merged = F.struct(*[F.coalesce(a[f], b[f]).alias(f) if f != "line_items" else F.col("_items").alias(f) for f in ("invoice_number", "date", "line_items", "subtotal", "tax", "total")])
    step = step.withColumn("merged", merged)
    m, items = F.col("merged"), F.col("_items")
    # Each of these is used many times over; a column of its own keeps the plan small.
    step = step.withColumns({"_row_sum": row_sum(items), "_product_hints": product_hints(items), "_total_hints": total_hints(m, include_tax)})
    step = step.withColumn("_sum_hints", sum_hints(m, F.col("_row_sum")))
    rows, products, sums, totals = (F.col(c) for c in ("_row_sum", "_product_hints", "_sum_hints", "_total_hints"))
    arithmetic = {"subtotal": subtotal_checks(m, rows, sums, totals), "total": total_checks(m, rows, totals)}
    closes = {"subtotal": sums.isNull() & totals.isNull(), "total": totals.isNull() & m["subtotal"].isNotNull()}
    sound = {f: a[f].isNotNull() & ~_bad_format(f, a[f]) & closes.get(f, F.lit(True)) for f in SCALARS}

    def scalar_fold(f: str) -> Column:
        # As for the rows: a value that was read alike and has nothing against it needs no list of checks.
        full = fold(scalar_checks(f, a, b, F.col("_single")) + format_checks(f, m) + arithmetic.get(f, []))
        return F.when(sound[f] & F.col("_single"), _nothing_but()).when(sound[f] & a[f].eqNullSafe(b[f]), _nothing_but(f"ENGINES_AGREE {f}")).otherwise(full)

    step = step.withColumns({f"_{f}": scalar_fold(f) for f in SCALARS})
    confirmed = m["tax"].isNull() & (F.col("_tax.rank") == 1) & (F.col("_subtotal.rank") == 0) & (F.col("_total.rank") == 0) & money_equal(m["subtotal"], m["total"])
    no_hints = F.array().cast(_NO_HINTS)
    green_tax = F.struct(F.lit(0).alias("rank"), F.lit(NO_TAX_CONFIDENCE).alias("confidence"), F.array(F.lit("NO_TAX_CONFIRMED")).alias("reasons"), F.col("_tax.hints").alias("hints"))
    step = step.withColumn("_tax", F.when(F.coalesce(confirmed, F.lit(False)), green_tax).otherwise(F.col("_tax")))
    default = F.when(F.col("_single"), F.lit("SINGLE_ENGINE_CHECKS_PASS")).otherwise(F.lit("ENGINES_AGREE_CHECKS_PASS"))

    def judged(field: Column, order: int, idx: Column, part: Column, text: Column, number: Column, f: Column) -> Column:
        return F.struct(field.alias("field"), F.lit(order).alias("field_ord"), idx.alias("idx"), part.alias("part"), text.alias("value_text"), number.alias("value_number"), *[f[c].alias(c) for c in ("status", "rank", "confidence", "reasons", "hints")])

    def verdict(field: Column, order: int, idx: Column, part: Column, text: Column, number: Column, f: Column) -> Column:
        return judged(field, order, idx, part, text, number, _judgement(f, default))

    nothing, no_text, no_number = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast(AMOUNT)
    scalars = F.array(*[verdict(F.lit(f), k, nothing, no_text, no_text if f in NUMERIC else m[f], m[f].cast(AMOUNT) if f in NUMERIC else no_number, F.col(f"_{f}")) for k, f in enumerate(SCALARS)])

    step = step.withColumn("scalar_verdicts", scalars)

    def part_verdict(x: Column, i: Column, p: str, beside: Column) -> Column:
        checks = part_checks(p, x, beside["other"], F.col("_single"))
        if p != "description":
            checks += product_checks(p, x, i, beside["hints"], beside["only"])
        if p == "line_total":
            checks += _violation(sums.isNotNull() & x[p].isNotNull(), _part_key(i, p), _SUM_REASON, sums)
        return fold(checks)

    passed = F.array(*[_judgement(_nothing_but(), F.lit("SINGLE_ENGINE_CHECKS_PASS")) for _ in PARTS])
    agreed = F.array(*[_judgement(_nothing_but(f"ENGINES_AGREE {p}"), default) for p in PARTS])

    def row_folds(x: Column, i: Column) -> Column:
        hints, other = F.get(products, i), F.get(F.col("_other"), i)
        beside = F.struct(other.alias("other"), hints.alias("hints"), culprit(hints).alias("only"))
        full = let(beside, lambda b: F.array(*[let(part_verdict(x, i, p, b), lambda f: _judgement(f, default)) for p in PARTS]))
        # Most rows are whole, close, and were read alike; what the checks say of such a row is known.
        sound = x["quantity"].isNotNull() & x["unit_price"].isNotNull() & x["line_total"].isNotNull() & hints.isNull() & sums.isNull()
        return F.when(sound & F.col("_single"), passed).when(sound & x.eqNullSafe(other), agreed).otherwise(full)

    # The folds come first, so that each is evaluated once a part.
    step = step.withColumn("_folds", F.transform(items, row_folds))
    value = lambda x, p: (x[p], no_number) if p == "description" else (no_text, x[p])
    of_row = lambda x, i, folds: F.array(*[judged(_part_key(i, p), 10 + k, i, F.lit(p), *value(x, p), F.get(folds, F.lit(k))) for k, p in enumerate(PARTS)])
    per_row = F.flatten(F.transform(items, lambda x, i: let(F.get(F.col("_folds"), i), lambda folds: of_row(x, i, folds))))
    step = step.withColumn("_rows", per_row)
    worst = F.coalesce(F.array_max(F.col("_rows")["rank"]), F.lit(0))
    n_rows = F.size(items)
    own = F.filter(F.array(F.when(F.col("_uneven"), F.lit("ROW_COUNT_DIFFERS")), F.when(n_rows == 0, F.lit("NO_ROWS"))), lambda r: r.isNotNull())
    reached = F.greatest(worst, F.when(F.col("_uneven"), 2).otherwise(0), F.when(n_rows == 0, 1).otherwise(0))
    # Without a reason of its own the group is green; its confidence still tells of the rows.
    group_rank = F.when(F.size(own) == 0, 0).otherwise(reached)
    base = F.element_at(F.array(*[F.lit(BASE_CONFIDENCE[s]) for s in STATUSES]), reached + 1)
    group = verdict(F.lit("line_items"), 99, nothing, no_text, no_text, n_rows.cast(AMOUNT), F.struct(group_rank.alias("rank"), base.alias("confidence"), own.alias("reasons"), no_hints.alias("hints")))
    return step.select(*[c for c in pairs.columns if c not in ("a", "b")], "merged", F.concat(F.col("scalar_verdicts"), F.col("_rows"), F.array(group)).alias("verdicts"), worst.alias("line_items_worst"), "scalar_verdicts")


def verdict_rows(verified: DataFrame, key: str = "invoice_id") -> DataFrame:
    """One row a verdict, in output order by (field_ord, idx)."""
    return verified.select(key, F.explode_outer("verdicts").alias("v")).select(key, "v.*")


def verdict_map(verified: DataFrame) -> Column:
    return F.map_from_entries(F.transform("verdicts", lambda v: F.struct(v["field"].alias("key"), v.alias("value"))))


def overall_worst(verdicts: Column, fields: tuple[str, ...]) -> Column:
    """The worst status over some fields."""
    ranks = F.transform(F.filter(verdicts, lambda v: v["field"].isin(*fields)), lambda v: v["rank"])
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.array_max(ranks) + 1)


REPORT_FIELDS = ("invoice_number", "date", "total")
SCREEN_FIELDS = (*SCALARS, "line_items")
