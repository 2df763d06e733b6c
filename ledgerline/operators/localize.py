"""Single-digit repairs: which one confusable digit would make a constraint hold.

A constraint is a function from candidate amounts to a boolean Column, so any
predicate can be localised.  Hints never change a value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..schemas import CENTS, alternates

MOST_HINTS = 3
HINT_TYPE = "struct<key:string,old:decimal(38,2),new:decimal(38,2)>"
#: For the rounding of logarithms.
_SLACK = 1e-9


def _alternates() -> Column:
    pairs = [c for digit, others in alternates().items() for c in (F.lit(digit), F.array(*map(F.lit, others)))]
    return F.create_map(*pairs)


def _exponents(off: Column, give: Column) -> tuple[Column, Column]:
    """The least and the greatest power of ten of which 1 to 9 times may be the distance, give or take."""
    least, most = F.abs(off) - give, F.abs(off) + give
    lowest = F.when(least > 0, F.ceil(F.log10(least / 9) - _SLACK))
    return F.coalesce(lowest, F.lit(-2)).cast("int"), F.floor(F.log10(most) + _SLACK).cast("int")


def _places(length: Column, off: Column | None, give: Column | None) -> Column:
    """The places of a printed amount, left to right; with a distance those whose digit can make up for it."""
    every = F.sequence(F.lit(1), length)
    if off is None:
        return every
    place = lambda power: F.when(power < 0, length - 2 - power).otherwise(length - 3 - power)

    def chosen(x: Column) -> Column:
        first, last = F.greatest(place(x["high"]), F.lit(1)), F.least(place(x["low"]), length)
        return F.when(x["low"].isNull() | x["high"].isNull(), every).when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))

    low, high = _exponents(off, give)
    return let(F.struct(F.when(off.isNotNull() & give.isNotNull(), low).alias("low"), high.alias("high")), chosen)


def _reaches(off: Column | None, give: Column | None) -> Column:
    """False if no digit from 1 to 9 and zeros are the distance, give or take."""
    if off is None:
        return F.lit(True)

    def reached(x: Column) -> Column:
        unit = F.pow(F.lit(10.0), F.floor(F.log10(x["most"]) + _SLACK))
        return F.floor(x["most"] / unit + 10 * _SLACK) * unit >= x["least"] * (1 - _SLACK)

    return F.coalesce(let(F.struct((F.abs(off) - give).alias("least"), (F.abs(off) + give).alias("most")), reached), F.lit(True))


def hints_for(key: Column, value: Column, holds: Callable[[Column], Column], off: Column | None = None, give: Column | None = None) -> Column:
    """For each digit of the value, left to right, the first alternate that satisfies ``holds``.

    ``off``, a double, says how far the value at cent precision is from every amount that may satisfy ``holds``,
    ``give`` or take: digits that can't make up for that are not tried.  Without it (or where it is null) all are.
    """

    def search(printed: Column) -> Column:
        def at(place: Column) -> Column:
            others = F.coalesce(F.element_at(_alternates(), F.substring(printed, place, F.lit(1))), F.array().cast("array<string>"))
            changed = F.transform(others, lambda d: F.concat(F.substring(printed, F.lit(1), place - 1), d, F.substring(printed, place + 1, F.char_length(printed))).cast(CENTS))
            return F.get(F.filter(changed, lambda v: (v != value) & holds(v)), F.lit(0))

        fits = F.filter(F.transform(_places(F.char_length(printed), off, give), at), lambda v: v.isNotNull())
        return F.transform(fits, lambda v: F.struct(key.alias("key"), value.cast(CENTS).alias("old"), v.alias("new")))

    return F.when(value.isNotNull() & _reaches(off, give), let(value.cast(CENTS).cast("string"), search)).otherwise(F.array().cast(f"array<{HINT_TYPE}>"))


def first_hints(hints: Sequence[Column]) -> Column:
    """At most three hints, in the order of the fields."""
    return F.slice(F.concat(*hints), 1, MOST_HINTS)


def culprit(hints: Column) -> Column:
    """The one field that every hint names; null if there are none or several."""
    keys = F.array_distinct(F.transform(hints, lambda h: h["key"]))
    return F.when(F.size(keys) == 1, F.get(keys, F.lit(0)))
