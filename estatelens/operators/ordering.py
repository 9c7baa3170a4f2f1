"""Sorting, with missing values last in both directions.

Further columns break ties. That makes the order definite, and it gives the
range partitioner something to split on when one value of the leading column
is very frequent. Tables of rows, unlike aggregated ones, may hold many rows that
are equal in all columns: ``spread`` lets the partitioner split those, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *order: Column) -> DataFrame:
    """Sorted rows; rows that are equal in all of ``order`` may lie in several ranges.

    A number that is different for each row stands behind the order.
    """
    return df.orderBy(*order, F.monotonically_increasing_id())


def ascending(df: DataFrame, *names: str) -> DataFrame:
    return df.orderBy(*(F.col(n).asc_nulls_last() for n in names))


def descending(df: DataFrame, name: str, *ties: str) -> DataFrame:
    return df.orderBy(
        F.col(name).desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in ties)
    )


def newest_then_ascending(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` newest rows, oldest of them first."""
    return df.orderBy(F.col(order).desc_nulls_last()).limit(n).orderBy(order)
