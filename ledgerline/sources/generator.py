"""Deterministic synthetic invoices: every value is a hash of the row's id, so any partition makes its own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import grouped, let, urdu_digits
from ..schemas import INVOICE, ITEMS, LABELS, SHOPS

MODES = ("clean", "mild", "heavy", "corrupted")
# Shares of the modes in each split (the rest is corrupted), and tax rates.
QUOTAS = {"dev": (0.35, 0.30, 0.25), "eval": (0.40, 0.25, 0.15)}
RATES = ("0.00", "0.13", "0.16", "0.17", "0.00", "0.13")


def _draw(salt: str, below: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(below)).cast("int")


def _pick(words: list[str] | tuple[str, ...], salt: str, *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), _draw(salt, len(words), *keys) + 1)


def stratified_modes(ids: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Split and mode with exact quotas: the last min(20, n / 5) rows are eval."""
    held = min(20, n // 5)
    split = F.when(F.col(key) >= n - held, F.lit("eval")).otherwise(F.lit("dev"))
    rank = F.row_number().over(Window.partitionBy("split").orderBy(F.xxhash64(F.lit(seed), key), key)) - 1
    mode = F.lit("corrupted")
    for name, size in (("dev", n - held), ("eval", held)):
        upto, chain = 0, None
        for m, share in zip(MODES, QUOTAS[name]):
            upto += int(size * share)
            test = (F.col("split") == name) & (F.col("_rank") < upto)
            chain = F.when(test, m) if chain is None else chain.when(test, m)
        mode = chain.otherwise(mode)
    return ids.withColumn("split", split).withColumn("_rank", rank).withColumn("mode", mode).drop("_rank")


def corrupt_digit(text: Column, *keys: Column) -> Column:
    """One of the digits replaced by another one."""
    digits = lambda t: F.filter(F.sequence(F.lit(1), F.char_length(t)), lambda p: F.substring(t, p, F.lit(1)).rlike(r"\d"))
    pick = lambda places: F.get(places, F.pmod(F.xxhash64(F.lit("place"), *keys), F.size(places)).cast("int"))

    def changed(x: Column) -> Column:
        t, at = x["t"], x["at"]
        new = F.pmod(F.substring(t, at, F.lit(1)).cast("int") + 1 + _draw("digit", 9, *keys), F.lit(10)).cast("string")
        return F.when(at.isNull(), t).otherwise(F.concat(F.substring(t, F.lit(1), at - 1), new, F.substring(t, at + 1, F.char_length(t))))

    return let(text, lambda t: let(F.struct(t.alias("t"), let(digits(t), lambda d: F.when(F.size(d) > 0, pick(d))).alias("at")), changed))


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """invoice_id, invoice (the truth), meta columns, printed_total and the text lines as printed."""
    rows = stratified_modes(spark.range(n), n, seed=seed)
    key = [F.lit(seed), F.col("id")]
    year = F.lit(2024) + _draw("year", 2, *key)
    day = F.make_date(year, _draw("month", 12, *key) + 1, _draw("day", 28, *key) + 1)
    head = F.when(_draw("prefix", 10, *key) < 7, F.lit("INV")).otherwise(F.lit("BL"))
    number = F.concat_ws("-", head, year.cast("string"), F.lpad((_draw("number", 9999, *key) + 1).cast("string"), 4, "0"))

    def item(i: Column) -> Column:
        at = [*key, i]
        cents = F.element_at(F.array(*[F.lit(x).cast("decimal(18,4)") for x in ("0.25", "0.50", "0.75")]), _draw("cents", 3, *at) + 1)
        odd = (_draw("small", 399, *at) + 2).cast("decimal(18,4)") + cents
        price = F.when(_draw("odd", 10, *at) < 3, odd).otherwise((_draw("price", 1496, *at) + 5).cast("decimal(18,4)")).cast("decimal(18,4)")
        quantity = (_draw("quantity", 40, *at) + 1).cast("decimal(18,4)")
        return F.struct(_pick(ITEMS, "item", *at).alias("description"), quantity.alias("quantity"), price.alias("unit_price"), (quantity * price).cast("decimal(18,2)").cast("decimal(18,4)").alias("line_total"))

    rows = rows.withColumns(
        {
            "number": number,
            "day": day,
            "items": F.transform(F.sequence(F.lit(1), _draw("rows", 4, *key) + 3), item),
            "rate": _pick(RATES, "rate", *key).cast("decimal(4,2)"),
            "digit_style": F.when(_draw("style", 2, *key) == 0, F.lit("urdu")).otherwise(F.lit("western")),
            "date_printed": F.when(_draw("date", 10, *key) < 7, F.date_format(day, "dd-MM-yyyy")).otherwise(F.date_format(day, "yyyy/MM/dd")),
        }
    )
    rows = rows.withColumn("subtotal", F.aggregate("items", F.lit(0).cast("decimal(18,4)"), lambda s, x: (s + x["line_total"]).cast("decimal(18,4)")))
    rows = rows.withColumn("tax", F.when(F.col("rate") > 0, (F.col("subtotal") * F.col("rate")).cast("decimal(18,2)").cast("decimal(18,4)")))
    rows = rows.withColumn("total", (F.col("subtotal") + F.coalesce("tax", F.lit(0))).cast("decimal(18,4)"))
    invoice = F.struct(F.col("number").alias("invoice_number"), F.date_format("day", "yyyy-MM-dd").alias("date"), F.col("items").alias("line_items"), "subtotal", "tax", "total").cast(INVOICE)
    wrong = corrupt_digit(grouped("total"), *key)
    rows = rows.withColumn("printed_total", F.when(F.col("mode") == "corrupted", styled(wrong)))
    return rows.select(F.lpad(F.col("id").cast("string"), 4, "0").alias("invoice_id"), invoice.alias("invoice"), "mode", "split", "digit_style", "printed_total", "date_printed", F.col("rate").cast("double").alias("tax_rate"), printed_lines(*key).alias("lines"))


def styled(text: Column, style: str = "digit_style") -> Column:
    return F.when(F.col(style) == "urdu", urdu_digits(text)).otherwise(text)


def printed_lines(*key: Column) -> Column:
    """The lines of the printed page; numbers are set in columns as wide as the widest."""
    amount = lambda c: styled(grouped(c))
    parts = ("quantity", "unit_price", "line_total")
    cells = F.transform("items", lambda x: F.struct(x["description"].alias("description"), *[grouped(x[p]).alias(p) for p in parts]))
    widest = lambda rows: F.struct(rows.alias("rows"), *[F.array_max(F.transform(rows, lambda x: F.char_length(x[p]))).alias(p) for p in parts])  # noqa: B023, E731
    cell = lambda x, w, part, gap: styled(F.lpad(x[part], w[part] + gap, " "))
    row = lambda w: lambda x: F.concat(x["description"], F.lit("  "), cell(x, w, "quantity", 1), F.lit("  "), cell(x, w, "unit_price", 2), F.lit("  "), cell(x, w, "line_total", 2))
    table = let(let(cells, widest), lambda w: F.transform(w["rows"], row(w)))
    label = lambda kind, k=0: F.lit(LABELS[kind][k] + ": ")
    number = F.concat(F.when(_draw("label", 2, *key) == 0, label("invoice_number")).otherwise(label("invoice_number", 1)), styled(F.col("number")))
    tax = F.when(F.col("tax").isNotNull(), F.concat(F.when(_draw("tax", 2, *key) == 0, label("tax")).otherwise(label("tax", 1)), amount("tax")))
    total = F.concat(label("total", 1), F.coalesce(F.col("printed_total"), amount("total")))
    lines = F.concat(
        F.array(_pick(SHOPS, "shop", *key), number, F.concat(label("date"), styled(F.col("date_printed"))), F.lit(LABELS["table_header"][0])),
        table,
        F.array(F.concat(label("subtotal"), amount("subtotal")), tax, total),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def misread(lines: Column, rate_per_100: int, *keys: Column) -> Column:
    """Recogniser noise in text, ours: some lines get one digit confused, some letters their Arabic variants."""
    return F.transform(lines, lambda x, i: F.when(_draw("noise", 100, *keys, i) < rate_per_100, corrupt_digit(F.translate(x, "یک", "يك"), *keys, i)).otherwise(x))
