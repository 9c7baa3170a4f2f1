"""Arithmetic with one missing value: NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(x: Column | str) -> Column:
    """A column from its name, or the column itself."""
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    x = column(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double; NULL when b is zero or either side is missing."""
    return F.try_divide(column(a).cast("double"), column(b).cast("double"))


def round_even(x: Column | str, digits: int = 0) -> Column:
    """Scale, round half to even, scale back.

    This is how array libraries round doubles, and unlike a decimal rounding
    it is one primitive operation per value. Adding zero turns -0.0 into 0.0.
    """
    x = column(x).cast("double")
    if digits == 0:
        return F.rint(x) + F.lit(0.0)
    scale = F.lit(10.0**digits)
    return F.rint(x * scale) / scale + F.lit(0.0)


def to_number(x: Column | str) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return column(x).try_cast("double")
