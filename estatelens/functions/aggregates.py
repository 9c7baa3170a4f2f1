"""Aggregate expressions.

Every one is algebraic (sums, counts, averages), so Spark combines on the map
side first and a hot group reaches the shuffle as one row per task.

``where`` restricts an aggregate to some rows of the group. It lets all
figures of a report screen come out of a single pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions.numeric import column, ratio


def _only(x: Column, where: Column | None) -> Column:
    return x if where is None else F.when(where, x)


def sum0(x: Column | str, where: Column | None = None) -> Column:
    """Sum that skips missing values; 0 when nothing is left."""
    return F.coalesce(F.sum(_only(column(x), where)), F.lit(0))


def sum_strict(x: Column | str, where: Column | None = None) -> Column:
    """Sum that is missing as soon as one value is; 0 for no rows."""
    x = column(x)
    missing = x.isNull() if where is None else where & x.isNull()
    return F.when(F.count_if(missing) == 0, sum0(x, where))


def count_rows(where: Column | None = None) -> Column:
    """Number of rows, or of the rows for which ``where`` holds."""
    return F.count(F.lit(1)) if where is None else F.count_if(where)


def mean(x: Column | str, where: Column | None = None) -> Column:
    """Average of the present values, NULL when there are none.

    The sum keeps the type of x, so that the average of decimals does not
    depend on the order of the rows.
    """
    x = _only(column(x), where)
    return ratio(F.sum(x), F.count(x))


def ratio_of_sums(
    a: Column | str, b: Column | str, factor: float = 1, where: Column | None = None
) -> Column:
    """factor * sum(a) / sum(b); each side skips its own missing values."""
    return ratio(sum0(a, where).cast("double") * F.lit(float(factor)), sum0(b, where))


def weighted_mean(
    value: Column | str, weight: Column | str, where: Column | None = None
) -> Column:
    """sum(weight * value) / sum(weight) over the rows kept by ``where``."""
    value, weight = column(value).cast("double"), column(weight).cast("double")
    return ratio(sum0(weight * value, where), sum0(weight, where))
