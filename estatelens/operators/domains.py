"""Value lists for selection boxes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def sorted_values(
    df: DataFrame, name: str, *, newest_first: bool = False, drop_smallest: bool = False
) -> DataFrame:
    """Distinct values in order, optionally without the smallest one."""
    values = distinct_values(df.where(F.col(name).isNotNull()), name)
    if drop_smallest:
        smallest = values.select(F.min(name)).scalar()
        values = values.where(F.col(name) > smallest)
    order = F.col(name).desc() if newest_first else F.col(name).asc()
    return values.orderBy(order)


def newest_value(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.max(name).alias(name))


def domains(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(name, value): the distinct values of several columns, as texts, in one pass over ``df``.

    Each row becomes one row for each column, and tasks drop what they have seen before
    anything is shuffled.
    """
    each = [F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names]
    return df.select(F.explode(F.array(*each)).alias("v")).select("v.*").distinct()
