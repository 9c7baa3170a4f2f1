"""The monthly and yearly land tables, rebuilt from the parcels.

The source database supplies these tables ready-made and the reports read
them as inputs; whoever has only the parcel table gets them from here. All of
them are small: one row per month, or per month and district.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.constants import TEN_THOUSAND
from estatelens.functions import (
    count_rows,
    mean,
    positive,
    ratio,
    ratio_of_sums,
    round_even,
    sum0,
)
from estatelens.operators import change_from_previous, outer_on_keys


def _dealt(land: DataFrame) -> DataFrame:
    return land.where(positive("deal_price") & F.col("month").isNotNull())


def _listed(land: DataFrame) -> DataFrame:
    return land.where(F.col("list_month").isNotNull())


def _change(df: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    return change_from_previous(df, value, "date", by=by, previous="previous")


def floor_price(where: Column | None = None) -> Column:
    floor_area = F.col("max_far") * F.col("site_area")
    return round_even(ratio_of_sums("deal_price", floor_area, TEN_THOUSAND, where))


def land_supply_month(land: DataFrame) -> DataFrame:
    """Parcels and area listed per month, change of the area."""
    months = _listed(land).groupBy(F.col("list_month").alias("date")).agg(
        count_rows().alias("count"), sum0("site_area").alias("area")
    )
    return change_from_previous(months, "area", "date")


def land_deal_month(land: DataFrame) -> DataFrame:
    """Parcels and area transferred per month, change of the area."""
    months = _dealt(land).groupBy(F.col("month").alias("date")).agg(
        count_rows().alias("count"), sum0("site_area").alias("area")
    )
    return change_from_previous(months, "area", "date")


def _supply_and_deal(land: DataFrame, supply_key: Column, deal_key: Column) -> DataFrame:
    supply = _listed(land).groupBy(supply_key.alias("date")).agg(sum0("site_area").alias("supply"))
    deal = _dealt(land).groupBy(deal_key.alias("date")).agg(sum0("site_area").alias("deal"))
    both = outer_on_keys(supply, deal, ["date"])
    return both.withColumn("ratio", round_even(ratio("supply", "deal"), 4))


def land_ratio_month(land: DataFrame) -> DataFrame:
    """Listed area / transferred area per month."""
    both = _supply_and_deal(land, F.col("list_month"), F.col("month"))
    return both.select("date", F.col("ratio").alias("supply_deal_ratio"))


def land_amount_month(land: DataFrame) -> DataFrame:
    """Sum of the deal prices (yuan) per month with its change."""
    return _change(
        _dealt(land).groupBy(F.col("month").alias("date"))
        .agg((sum0("deal_price") * TEN_THOUSAND).alias("value"))
    )


def land_floor_month(land: DataFrame) -> DataFrame:
    """Floor price per month with its change."""
    return _change(
        _dealt(land).groupBy(F.col("month").alias("date")).agg(floor_price().alias("value"))
    )


def _floor_pair(land: DataFrame, key: Column) -> DataFrame:
    return _dealt(land).groupBy(key.alias("date")).agg(
        floor_price().alias("floor_price"),
        floor_price(F.col("is_residential")).alias("res_floor_price"),
    )


def _year_start(day: str) -> Column:
    return F.trunc(day, "year")


def land_floor_pair_month(land: DataFrame) -> DataFrame:
    """Floor price of all uses next to that of residential uses."""
    return _floor_pair(land, F.col("month"))


def land_floor_pair_year(land: DataFrame) -> DataFrame:
    return _floor_pair(land, _year_start("deal_time"))


def _residential_proper(land: DataFrame) -> DataFrame:
    return land.where(F.col("is_residential") & F.col("is_proper"))


def land_residential_month(land: DataFrame) -> DataFrame:
    """Residential area in the city proper: listed, transferred, ratio."""
    return _supply_and_deal(_residential_proper(land), F.col("list_month"), F.col("month"))


def land_residential_year(land: DataFrame) -> DataFrame:
    return _supply_and_deal(
        _residential_proper(land), _year_start("list_start"), _year_start("deal_time")
    )


def _by_district(land: DataFrame, value: Column) -> DataFrame:
    months = (
        _dealt(land).where("is_commercial")
        .groupBy(F.col("month").alias("date"), "district")
        .agg(value.alias("value"))
    )
    return _change(months, by=["district"])


def land_district_amount(land: DataFrame) -> DataFrame:
    """Commercial deal prices (yuan) per month and district, change per district."""
    return _by_district(land, sum0("deal_price") * TEN_THOUSAND)


def land_district_mean(land: DataFrame) -> DataFrame:
    """Mean commercial deal price (yuan) per month and district."""
    return _by_district(land, round_even(mean("deal_price") * TEN_THOUSAND, 2))
