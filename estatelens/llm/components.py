"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch

#: A key with more than this share of the rows is a hub, so there are at most 1,000 hubs.
HUBS = 1000


def lookup(rows: DataFrame, keys: str | list[str], found: DataFrame, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``found`` (keys, m, n), where n is how many of ``total`` rows have the keys.

    The rows of a hub stay where they are: hubs, at most ``HUBS`` of them by their definition,
    are broadcast with their m. All other keys are joined by a shuffle, in which none has
    more than a thousandth of the rows.
    """
    keys = [keys] if isinstance(keys, str) else keys
    hubs = found.where(F.col("n") * HUBS > total).select(*keys, F.col("m").alias("__hub"))
    tagged = rows.join(F.broadcast(hubs), keys, "left")
    rest = tagged.where("__hub is null").drop("__hub").join(found.select(*keys, "m"), keys)
    return tagged.where("__hub is not null").withColumnRenamed("__hub", "m").unionByName(rest)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Tie the larger neighbours of each node to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return lookup(both.where("v > u"), "u", least, 2 * count).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    ).where("u <> v").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = lookup(down, "u", least, count)
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    ).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v); root is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes. Every
    step is a written table, so a lost executor costs at most one step. Hubs
    are grouped with partial aggregates and looked up without a shuffle.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.table(edges.select("u", "v").where("u <> v").distinct(), "edges0")
    seen, turn = state(now), 0
    while seen[0]:
        turn += 1
        large = scratch.table(_large_star(now, seen[0]), f"large{turn}")
        after = scratch.table(_small_star(large, large.count()), f"edges{turn}")
        scratch.drop(f"large{turn}")
        scratch.drop(f"edges{turn - 1}")
        now, before, seen = after, seen, state(after)
        if before == seen:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
