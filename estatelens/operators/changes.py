"""Change against an earlier period, share of the whole.

These run on aggregated series only: one row per period, or per period and
region. Windows without a partition therefore see at most as many rows as
there are periods in the calendar (or regions, for shares), whatever the size
of the tables underneath.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions import ratio, round_even


def _growth(value: Column, previous: Column, digits: int | None) -> Column:
    change = ratio(value, previous) - 1
    return change if digits is None else round_even(change, digits)


def change_from_previous(
    df: DataFrame,
    value: str,
    order: str,
    *,
    by: Sequence[str] = (),
    rows: int = 1,
    digits: int | None = 4,
    change: str = "change",
    previous: str | None = None,
) -> DataFrame:
    """value / value ``rows`` rows earlier - 1, inside each ``by`` group.

    Earlier means earlier rows, not calendar periods: a missing period shifts
    the comparison. The first rows have no change.
    """
    window = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())
    before = F.lag(value, rows).over(window)
    out = df.withColumn("__before", before)
    out = out.withColumn(change, _growth(F.col(value), F.col("__before"), digits))
    if previous:
        return out.withColumnRenamed("__before", previous)
    return out.drop("__before")


def change_by_calendar(
    df: DataFrame,
    value: str,
    order: str,
    *,
    by: Sequence[str] = (),
    months: int = 12,
    digits: int | None = 4,
    change: str = "change",
) -> DataFrame:
    """value / value exactly ``months`` months earlier - 1.

    A period without that earlier month has no change. ``order`` is a date and
    unique inside a ``by`` group.
    """
    key = "__period"
    earlier = df.select(
        F.struct(*by, F.add_months(order, months).alias(order)).alias(key),
        F.col(value).alias("__before"),
    )
    # a struct as key, so that a missing region finds its own earlier period
    return (
        df.withColumn(key, F.struct(*by, order))
        .join(earlier, key, "left")
        .select(*df.columns, _growth(F.col(value), F.col("__before"), digits).alias(change))
    )


def with_share(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Part of ``value`` in its total over all rows of an aggregated result."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(name, ratio(F.col(value), total))
