"""Screen "deals of new homes"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.constants import HOME_AREA_BOUNDS, MISSING, TEN_THOUSAND
from estatelens.functions import (
    floor_bound,
    in_period,
    last_days,
    mean,
    member,
    number_text,
    positive,
    round_even,
    sum0,
    sum_strict,
    weighted_mean,
    within,
)
from estatelens.operators import descending
from estatelens.schemas import HEADINGS


def _chosen(deals: DataFrame, regions, category, period, as_of) -> DataFrame:
    return deals.where(
        in_period(deals, "date", period or last_days(30, as_of))
        & member("region", regions)
        & member("category", category)
    )


def deal_kpis(
    deals: DataFrame, *, regions, category, period=None, min_area=None, max_area=None, as_of=None
) -> DataFrame:
    """Units, area (10,000 ㎡) and area-weighted price (10,000 yuan/㎡).

    The lower size bound is part of the range for the units, but not for the
    area and the price.
    """
    low = HOME_AREA_BOUNDS[0]
    above = floor_bound("unit_area", min_area, low, inclusive=False)
    rows = _chosen(deals, regions, category, period, as_of).where(
        within("unit_area", min_area, max_area, HOME_AREA_BOUNDS)
    )
    price = weighted_mean("res_price", "area", above & positive("res_price"))
    return rows.agg(
        sum_strict("units").alias("units"),
        round_even(sum_strict("area", above) / TEN_THOUSAND, 2).alias("area"),
        round_even(price / TEN_THOUSAND, 2).alias("price"),
    )


def deal_table(
    deals: DataFrame, *, regions, category, period=None, min_area=None, max_area=None, as_of=None
) -> DataFrame:
    """Projects by units sold; the mean price is text, with a "no data" label."""
    rows = _chosen(deals, regions, category, period, as_of).where(
        within("unit_area", min_area, max_area, HOME_AREA_BOUNDS, inclusive=False)
    )
    price = number_text(round_even(mean("res_price")))
    projects = rows.groupBy("record_name", "promo_name", "region").agg(
        sum0("units").alias("units"),
        sum0("area").alias("area"),
        F.coalesce(price, F.lit(MISSING)).alias("price_label"),
    )
    return descending(
        projects.select(*HEADINGS["deal_table"]), "units", "record_name", "promo_name", "region"
    )
