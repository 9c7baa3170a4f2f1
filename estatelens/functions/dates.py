"""Dates, month keys and year keys."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.functions.numeric import column

# fixed values: the date notations that are understood, slashes read as dashes
DASHED = r"^\d{4}-\d{1,2}-\d{1,2}$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"


def parse_date(x: Column | str) -> Column:
    """Text such as 2019-3-1, 2019/03/01 or 20190301 to a date.

    Anything else becomes NULL. The cast does the work; unlike a list of date
    patterns it costs no exception for each text that does not fit.
    """
    dashed = F.regexp_replace(slash_to_dash(x), COMPACT, "$1-$2-$3")
    return F.when(dashed.rlike(DASHED), dashed.try_cast("date"))


def as_date(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a date, parsing only where it is text.

    A column that is a date already stays bare, so that filters on it still
    reach the scan.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.col(name)
    if isinstance(kind, T.StringType):
        return parse_date(name)
    return F.col(name).cast("date")


def month_key(x: Column | str) -> Column:
    """'yyyy-MM': the first seven characters of a date or date text."""
    return F.substring(column(x).cast("string"), 1, 7)


def year_key(x: Column | str) -> Column:
    """'yyyy': the first four characters of a date or date text."""
    return F.substring(column(x).cast("string"), 1, 4)


def slash_to_dash(x: Column | str) -> Column:
    return F.translate(column(x).cast("string"), "/", "-")


def first_of_month(as_of: date) -> Column:
    return F.trunc(F.lit(as_of), "MM").cast("date")


def last_of_previous_month(as_of: date) -> Column:
    return F.date_sub(first_of_month(as_of), 1)


def last_days(days: int, as_of: date | None = None) -> tuple[date, date]:
    """The default report window: ``days`` ago until yesterday."""
    as_of = as_of or date.today()
    return as_of - timedelta(days=days), as_of - timedelta(days=1)
