"""Screen "land parcels": figures and parcel list for one choice of parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.constants import CITY_PROPER, LAND_AREA_BOUNDS, TEN_THOUSAND
from estatelens.functions import (
    choice,
    count_rows,
    in_period,
    last_days,
    member,
    positive,
    ratio_of_sums,
    round_even,
    sum_strict,
    within,
)
from estatelens.schemas import HEADINGS


def chosen_parcels(
    land: DataFrame,
    *,
    listed: tuple | None = None,
    dealt: tuple | None = None,
    districts=(CITY_PROPER,),
    parcel_nos=None,
    locations=None,
    land_uses=None,
    min_area=None,
    max_area=None,
    as_of=None,
) -> DataFrame:
    """Parcels listed and dealt in the given periods (default: one year).

    A parcel without a deal date never counts, not even as listed. The bounds of the
    area hold for a missing area as for zero; that it is missing or large enough is asked
    of the stored column, too, where a scan can check it.
    """
    year = last_days(365, as_of)
    size = within("site_area", min_area, max_area, LAND_AREA_BOUNDS)
    if "known_area" in land.columns:
        size &= F.col("known_area").isNull() | within("known_area", min_area, max_area, LAND_AREA_BOUNDS)
    return land.where(
        in_period(land, "list_start", listed or year, "list_year")
        & in_period(land, "deal_time", dealt or year, "deal_year")
        & member("district", districts)
        & choice("parcel_no", parcel_nos)
        & choice("location", locations)
        & choice("land_use", land_uses)
        & size
    )


def _area(where: Column | None = None) -> Column:
    return round_even(sum_strict("site_area", where) / TEN_THOUSAND, 1)


def _floor_price(price: str, where: Column | None = None) -> Column:
    floor_area = F.col("max_far") * F.col("site_area")
    return round_even(ratio_of_sums(price, floor_area, TEN_THOUSAND, where))


def land_query_kpis(land: DataFrame, **choices) -> DataFrame:
    """Count, area (10,000 ㎡) and floor price, listed and transferred."""
    sold = positive("deal_price")
    return chosen_parcels(land, **choices).agg(
        count_rows().alias("listed_count"),
        _area().alias("listed_area"),
        _floor_price("start_price").alias("listed_floor_price"),
        count_rows(sold).alias("dealt_count"),
        _area(sold).alias("dealt_area"),
        _floor_price("deal_price", sold).alias("dealt_floor_price"),
    )


def land_query_table(land: DataFrame, **choices) -> DataFrame:
    return chosen_parcels(land, **choices).select(*HEADINGS["land_query_table"])
