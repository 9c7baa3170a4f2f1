"""Filter conditions. A condition that is NULL for a row drops the row."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.numeric import column


def between(x: Column | str, span: tuple) -> Column:
    """Inside ``span``, both ends included; works for dates and month keys."""
    low, high = span
    return column(x).between(F.lit(low), F.lit(high))


def in_period(df: DataFrame, day: str, span: tuple, folder: str = "year") -> Column:
    """As :func:`between` for a day of ``df``; also by ``folder`` where the table is stored in folders of years."""
    inside = between(day, span)
    if folder not in df.columns:
        return inside
    low, high = (int(str(x)[:4]) for x in span)
    return inside & F.col(folder).between(low, high)


def days_of(months: tuple[str, str]) -> tuple[date, date]:
    """The first and the last day of a pair of months 'yyyy-MM'."""
    low, high = (date(int(m[:4]), int(m[5:7]), 1) for m in months)
    return low, high.replace(day=monthrange(high.year, high.month)[1])


def member(x: Column | str, values: Iterable | object) -> Column:
    """x is one of ``values``; a single text counts as one value."""
    values = [values] if isinstance(values, str) or not isinstance(values, Iterable) else list(values)
    return column(x).isin(values) if values else F.lit(False)


def not_member(x: Column | str, values: Iterable) -> Column:
    """x is none of ``values``; rows with a missing x stay in."""
    return ~F.coalesce(member(x, values), F.lit(False))


def choice(x: Column | str, values: Iterable | None) -> Column:
    """Multiple choice: nothing chosen means no filter, missing x included."""
    if values is None or (not isinstance(values, str) and not list(values)):
        return F.lit(True)
    return member(x, values)


def _bound(text: object, default: float) -> Column:
    """A bound typed by a user: empty means the default, nonsense is NULL."""
    if text is None or (isinstance(text, str) and text == ""):
        return F.lit(float(default))
    if isinstance(text, str):
        return F.lit(text).try_cast("double")
    return F.lit(float(text))


def floor_bound(
    x: Column | str, low: object, default: float, *, inclusive: bool = True
) -> Column:
    """x is above ``low`` (or at it, when inclusive)."""
    x, low = column(x), _bound(low, default)
    return x >= low if inclusive else x > low


def within(
    x: Column | str,
    low: object,
    high: object,
    defaults: tuple[float, float],
    *,
    inclusive: bool = True,
) -> Column:
    """x lies between two user bounds.

    The defaults are bounds like any other: rows with a missing x or an x
    above the default upper bound drop even when no bound was given.
    """
    return floor_bound(x, low, defaults[0], inclusive=inclusive) & (
        column(x) <= _bound(high, defaults[1])
    )


def positive(x: Column | str) -> Column:
    return column(x) > 0
