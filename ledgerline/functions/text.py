"""Text, amount and date expressions.  All are JVM-side Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import AMOUNT, CENTS, NARROW

ColumnOrName = Column | str

# Characters that are unified before any comparison.
_DIGITS = "".join(chr(0x06F0 + d) for d in range(10)) + "".join(chr(0x0660 + d) for d in range(10))
_LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک"}
_MARKS = {"،": ",", "؛": ";", "؟": "?", "۔": ".", "٫": ".", "“": '"', "”": '"', "‘": "'", "’": "'"}
_DROPPED = "​‌‍⁠﻿‎‏؜ـ٬"

_FROM = _DIGITS + "".join(_LETTERS) + "".join(_MARKS) + _DROPPED
_TO = "0123456789" * 2 + "".join(_LETTERS.values()) + "".join(_MARKS.values())

#: Everything that Unicode calls white space, and the information separators.
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
AMOUNT_TOKEN = r"\d[\d,]*(?:\.\d+)?"
SIGNED_AMOUNT = "-?" + AMOUNT_TOKEN
DATE_TOKEN = r"\d{4}[-/. ]\d{1,2}[-/. ]\d{1,2}|\d{1,2}[-/. ]\d{1,2}[-/. ]\d{4}"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(c: ColumnOrName) -> Column:
    """Unicode compatibility composition; an ASCII text needs none."""
    text = _col(c)
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(composed)


def strip(c: ColumnOrName) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), rf"^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def _unified(text: Column) -> Column:
    return strip(F.regexp_replace(F.translate(text, _FROM, _TO), r"[ \t\xa0]+", " "))


def normalize_digits(c: ColumnOrName) -> Column:
    """Digits, letters, marks and blanks unified; null is empty."""
    return _unified(F.coalesce(_col(c), F.lit("")))


def normalize_text(c: ColumnOrName) -> Column:
    """The same after Unicode compatibility composition."""
    return _unified(nfkc(F.coalesce(_col(c), F.lit(""))))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def any_of(words: list[str]) -> str:
    """The pattern of any of some words."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def amount_of(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit("")).try_cast(AMOUNT)


def parse_amount(c: ColumnOrName) -> Column:
    """The first number of a text, commas dropped; null if there is none."""
    return amount_of(found(normalize_digits(c), SIGNED_AMOUNT))


def first_amount(c: ColumnOrName) -> Column:
    """The first unsigned number token, as text."""
    return found(_col(c), AMOUNT_TOKEN)


def parse_date(c: ColumnOrName) -> Column:
    """The first date-shaped token as a date; null unless it is a calendar day."""

    def parsed(token: Column) -> Column:
        parts = F.split(token, "[-/. ]")
        year_first = F.char_length(F.get(parts, F.lit(0))) == 4
        year = F.get(parts, F.when(year_first, 0).otherwise(2))
        day = F.get(parts, F.when(year_first, 2).otherwise(0))
        return F.when(year.cast("int") >= 1, F.try_to_date(F.concat_ws("-", year, F.get(parts, F.lit(1)), day), "yyyy-M-d"))

    # Dates as the engine itself writes them need no search.
    text = _col(c)
    plain = F.when(F.substring(text, 1, 4) != "0000", text.try_cast("date"))
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), plain).otherwise(let(found(normalize_digits(text), DATE_TOKEN), parsed))


def iso_date(c: ColumnOrName) -> Column:
    return F.date_format(parse_date(c), "yyyy-MM-dd")


def iso_or_raw(c: ColumnOrName) -> Column:
    return F.coalesce(iso_date(c), _col(c))


def edit_distance(a: ColumnOrName, b: ColumnOrName, limit: int | None = None) -> Column:
    """Levenshtein distance; with a limit, limit + 1 stands for all that is more."""
    if limit is None:
        return F.levenshtein(a, b)
    near = F.levenshtein(a, b, limit)
    return F.when(near < 0, F.lit(limit + 1)).otherwise(near)


def similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 less the edit distance over the longer length, of the unified texts; null is empty."""

    def ratio(p: Column) -> Column:
        x, y = p["x"], p["y"]
        longer, shorter = F.greatest(F.char_length(x), F.char_length(y)), F.least(F.char_length(x), F.char_length(y))
        return F.when(longer == 0, F.lit(1.0)).when(shorter == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y) / longer)

    return let(F.struct(normalize_digits(a).alias("x"), normalize_digits(b).alias("y")), ratio)


def cents(c: ColumnOrName) -> Column:
    """At cent precision; null if that has too many digits."""
    return _col(c).try_cast(CENTS)


def money_equal(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Equal at cent precision; null if a side is null or too large."""
    return cents(a) == cents(b)


def plus(a: ColumnOrName, b: ColumnOrName) -> Column:
    """A sum; null if it has too many digits."""
    return F.try_add(a, b)


def product_cents(a: ColumnOrName, b: ColumnOrName) -> Column:
    """A product at cent precision: exact for factors below 10^14, else of six decimals; null if it has too many digits."""
    a, b = _col(a), _col(b)
    # A cast that fails costs an exception, so numbers and products that are clearly too large are left out first.
    narrow = lambda v: F.when(F.abs(v) <= 10**14, v.try_cast(NARROW))
    within = F.abs(a.cast("double") * b.cast("double")) < 1.01e32
    return F.coalesce(cents(narrow(a) * narrow(b)), F.when(within, cents(F.try_multiply(a.cast(AMOUNT), b.cast(AMOUNT)))))


def urdu_digits(c: ColumnOrName) -> Column:
    return F.translate(_col(c), "0123456789", _DIGITS[:10])


def grouped(c: ColumnOrName) -> Column:
    """An amount as it is printed: thousands separated, cents only if there are any."""
    return let(cents(c), lambda v: F.call_function("format_number", v, F.when(F.endswith(v.cast("string"), F.lit(".00")), 0).otherwise(2)))


def shown(c: ColumnOrName) -> Column:
    """An amount in a table: two decimals, a dash for null."""
    return F.coalesce(F.format_number(cents(c), 2), F.lit("—"))
