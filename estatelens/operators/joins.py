"""Joins.

Spark compares each side with ``spark.sql.autoBroadcastJoinThreshold``, at planning
time and again with the real size at run time, and otherwise sorts and merges. A side
is broadcast by hint only after its rows were counted, see ``broadcast_if_small``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Left join in which a missing key matches a missing key.

    ``on`` maps left key columns to right key columns; the right keys are not
    part of the result. A key that is repeated on the right repeats the left
    row.

    Both inputs are always shuffled by the null-safe form of the key, also
    when the right one was grouped by the same key before. That costs one
    exchange of the (small) right side and lets adaptive execution split a hot
    key of the left side over many tasks, which it only does for sort-merge
    joins directly on top of two shuffles.
    """
    keys = {r: f"__key_{i}" for i, r in enumerate(on.values())}
    right = right.withColumnsRenamed(keys)
    match = [left[l].eqNullSafe(right[keys[r]]) for l, r in on.items()]
    return left.join(right, reduce(lambda a, b: a & b, match), "left").drop(*keys.values())


#: With a few short columns, as promotion names have, this is a few dozen MB at most.
SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; as it is otherwise.

    Counts at once, and no further than needed. For narrow tables that a large one is
    joined with: the large one then isn't shuffled. Beyond the bound the join sorts and
    merges, and a hot key is split.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of some hundred bytes that a task sorts or aggregates in 100 to 200 MB.
TASK_ROWS = 250_000


def tasks_for(rows: int) -> int:
    """Partitions with ``TASK_ROWS`` rows each, for tables whose rows were counted.

    Partitions that Spark sizes by their shuffled bytes hold as many narrow rows as
    compress to that size, or fewer by the number of cores; what a task needs for them
    once they are decoded and widened grows with the table. A number of rows bounds it.
    """
    return max(1, -(-rows // TASK_ROWS))


def plain_keys(*names: str) -> dict[str, Column]:
    """Text key columns as columns without NULL, equal where the keys are.

    Grouping and joining by them treats missing keys as equal to each other
    with ordinary equality, so a join can use the partitioning of a grouping.
    """
    keys = {}
    for name in names:
        keys[f"__{name}"] = F.coalesce(name, F.lit(""))
        keys[f"__{name}_missing"] = F.col(name).isNull()
    return keys


def outer_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two roll-ups; the key columns are coalesced."""
    return left.join(right, list(keys), "full")


def side_by_side(*parts: DataFrame) -> DataFrame:
    """One row out of several one-row results with different columns."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))
