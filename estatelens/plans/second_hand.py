"""Screen "second-hand homes". Areas come in 10,000 ㎡ and leave in ㎡."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.constants import TEN_THOUSAND
from estatelens.functions import member, sum0
from estatelens.operators import ascending, pivot_series


def second_hand_by_region(market: DataFrame, month, regions) -> DataFrame:
    """Units and area of one month per region."""
    return market.where(member("month", month) & member("region", regions)).groupBy("region").agg(
        sum0("units").alias("units"), (sum0("area") * TEN_THOUSAND).alias("area")
    )


def _series(market: DataFrame, regions) -> DataFrame:
    return market.where(member("region", regions))


def second_hand_units_series(market: DataFrame, regions) -> DataFrame:
    """Units per month, one series per region, in long form."""
    rows = _series(market, regions).select("region", "date", "month", "units")
    return ascending(rows, "date", "region")


def second_hand_area_series(market: DataFrame, regions) -> DataFrame:
    rows = _series(market, regions).select(
        "region", "date", "month", (F.col("area") * TEN_THOUSAND).alias("area")
    )
    return ascending(rows, "date", "region")


def second_hand_units_wide(market: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Units per month with one column per region."""
    wide = pivot_series(_series(market, regions), "month", "region", regions, F.sum("units"))
    return ascending(wide, "month")
