"""Predicates that split a database table into parts of similar size.

A stride over a number (``Partitioning``) needs bounds and evenly spread values. These
predicates take any column that the database can order: text keys and dates, missing values
and very frequent values included. Each row satisfies exactly one predicate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def literal(value: object) -> str:
    """A value as SQL text; texts, dates and times are quoted."""
    if isinstance(value, bool) or not isinstance(value, (str, int, float, Decimal, date, datetime)):
        raise TypeError(f"{value!r} cannot split a table")
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    text = value if isinstance(value, str) else value.isoformat(*([" "] if isinstance(value, datetime) else []))
    return "'" + text.replace("'", "''") + "'"


def range_predicates(
    column: str,
    bounds: Sequence,
    frequent: Mapping[object, Sequence[str]] | Sequence = (),
    *,
    nullable: bool = True,
) -> list[str]:
    """Conditions on ``column``, one of which holds for each row.

    ``bounds`` begin the ranges after the first. Values in ``frequent`` get a part of their
    own; as a mapping, each names the predicates (on another column, from this function) by
    which its rows are split further. Missing values are a part too, unless the column has
    none. The database has to order the column as Python orders the bounds: for texts with
    a collation, name an expression such as ``CAST(name AS BINARY)`` as the column.
    """
    frequent = frequent if isinstance(frequent, Mapping) else dict.fromkeys(frequent, ())
    cuts = sorted({*bounds, *frequent})
    parts = []
    low = None
    for cut in [*cuts, None]:
        ends = [f"{column} {'>' if low in frequent else '>='} {literal(low)}"] if low is not None else []
        ends += [f"{column} < {literal(cut)}"] if cut is not None else []
        parts.append(" AND ".join(ends) or f"{column} IS NOT NULL")
        if cut in frequent:
            own = f"{column} = {literal(cut)}"
            parts += [f"{own} AND ({more})" for more in frequent[cut]] or [own]
        low = cut
    return parts + [f"{column} IS NULL"] * nullable


def quantiles(sample: DataFrame, column: str, parts: int) -> tuple[list, list]:
    """Bounds and frequent values of ``column``, out of a copy or a sample of the table.

    An earlier load of the table serves well. The values are dealt into ranges of similar
    size; a value that fills more than twice the median range is frequent. At most ``parts``
    of either come to the driver.
    """
    present = sample.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    # few, as one row stands for all equal ones in a task
    counted = present.groupBy("value").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0]
    if not total:
        return [], []
    often = counted.where(F.col("n") * parts > 2 * total).select("value")
    frequent = sorted(r.value for r in often.collect())
    rest = present.join(F.broadcast(often), "value", "left_anti") if frequent else present
    dealt = rest.repartitionByRange(parts, "value").groupBy(F.spark_partition_id()).agg(F.min("value").alias("value"))
    return sorted(r.value for r in dealt.collect())[1:], frequent
