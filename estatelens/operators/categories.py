"""Raw class texts to a few categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.numeric import column


def category(raw: Column | str, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """Category of a raw class; unknown and missing classes get ``default``.

    The groups are a short fixed list, so this is a set test inside the
    generated code and no join at all.
    """
    raw = column(raw)
    result = F.when(F.lit(False), F.lit(default))
    for name, members in groups.items():
        result = result.when(raw.isin(list(members)), F.lit(name))
    return result.otherwise(F.lit(default))


def with_category(
    df: DataFrame, raw: str, mapping: DataFrame, default: str, name: str = "category"
) -> DataFrame:
    """Category from a mapping table with the columns ``raw`` and ``category``.

    For mappings that are kept as data. The mapping must have one row per
    class. Whether it is broadcast is left to Spark, which checks its size.
    """
    pairs = mapping.select(F.col("raw").alias("__raw"), F.col("category").alias("__category"))
    return (
        df.join(pairs, df[raw] == pairs["__raw"], "left")
        .withColumn(name, F.coalesce("__category", F.lit(default)))
        .drop("__raw", "__category")
    )
