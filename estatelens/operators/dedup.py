"""Last row per key, last row of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes last in ``order``.

    Missing keys form a key of their own. The other columns break ties, in
    their order, so that the choice never depends on the order of the rows.

    Spark limits each task's own rows to one per key before the shuffle (it
    turns the filter on the row number into a window group limit), so a key
    that holds a third of the table is never gathered in one place.
    """
    newest_first = Window.partitionBy(*keys).orderBy(
        *(F.col(c).desc_nulls_last() for c in dict.fromkeys([*order, *df.columns]) if c not in keys)
    )
    numbered = df.withColumn("__position", F.row_number().over(newest_first))
    return numbered.where(F.col("__position") == 1).drop("__position")


def latest_row(df: DataFrame, order: str, *ties: str) -> DataFrame:
    """The row with the highest ``order``, missing ones last; none if empty."""
    last = F.max_by(F.struct(*df.columns), F.struct(order, *ties)).alias("__last")
    return df.agg(last).where(F.col("__last").isNotNull()).select("__last.*")
