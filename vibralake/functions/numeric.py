"""Number and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text. Casting alone is too lenient: it also takes
# a trailing type letter and hexadecimal floats.
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
# The same, or the word for a missing number.
NUMBER_OR_NAN = NUMBER.replace("[iI][nN][fF]", "[nN][aA][nN]|[iI][nN][fF]")


def number_or_zero(text: Column) -> Column:
    """Text to double; anything unreadable, missing or NaN is 0.0, infinity stays."""
    return F.coalesce(F.nanvl(F.when(text.rlike(NUMBER), text.try_cast("double")), F.lit(0.0)), F.lit(0.0))


def double_or_zero(number: Column) -> Column:
    """The same for a column that is numeric already."""
    return F.coalesce(F.nanvl(number.cast("double"), F.lit(0.0)), F.lit(0.0))


def finite_or_zero(number: Column) -> Column:
    """NaN, null and both infinities become 0.0."""
    return F.when(F.abs(number) < F.lit(float("inf")), number).otherwise(F.lit(0.0))


def timestamp(text: Column, strict: bool = True) -> Column:
    """Parse a timestamp; strict parsing fails on bad text, otherwise it is null."""
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def clamp(number: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), number))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0.0 where the denominator is zero or either side is null."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))
