"""Screen "sell-through, volume and price" of new homes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions import (
    first_of_month,
    in_period,
    last_days,
    last_of_previous_month,
    member,
    or_missing,
    positive,
    ratio,
    sum0,
    sum_strict,
    weighted_mean,
)
from estatelens.operators import ascending, change_from_previous, descending, spread, with_share
from estatelens.schemas import HEADINGS


def sell_through_by_region(ratios: DataFrame, as_of: date | None = None) -> DataFrame:
    """Units sold / units for sale per region up to the end of last month.

    Totals are summed before they are subtracted, unlike in the supply/sale
    ratio; the two differ where values are missing.
    """
    rows = ratios.where(F.col("date") <= last_of_previous_month(as_of or date.today()))
    share = ratio(sum0("units"), sum0("total_units") - sum0("non_sale"))
    return descending(
        rows.groupBy("short_region").agg(share.alias("sell_through")),
        "sell_through", "short_region",
    )


def units_by_band(deals: DataFrame, *, period=None, as_of=None) -> DataFrame:
    """Units sold per size band with their share; one missing count makes the
    sum of its band missing."""
    rows = deals.where(in_period(deals, "date", period or last_days(30, as_of)))
    bands = rows.groupBy("band").agg(sum_strict("units").alias("units"))
    return descending(with_share(bands, "units"), "units", "band")


def _priced_by_year(deals: DataFrame, regions):
    priced = deals.where(positive("res_price") & member("region", regions))
    return priced.groupBy(F.year("date").alias("year"))


def price_yearly(deals: DataFrame, *, regions) -> DataFrame:
    """Units and area-weighted price per year; deals without a price would
    pull the price down and are left out."""
    return ascending(
        _priced_by_year(deals, regions).agg(
            sum_strict("units").alias("units"),
            weighted_mean("res_price", "area").alias("price"),
        ),
        "year",
    )


def price_yearly_change(deals: DataFrame, *, regions) -> DataFrame:
    years = _priced_by_year(deals, regions).agg(
        weighted_mean("res_price", "area").alias("price")
    )
    return ascending(change_from_previous(years, "price", "year"), "year")


def new_openings(projects: DataFrame, as_of: date | None = None) -> DataFrame:
    """Projects opened since the first of this month, newest first."""
    rows = projects.where(F.col("date") >= first_of_month(as_of or date.today()))
    rows = rows.select(
        "record_name",
        or_missing("promo_name").alias("promo_name"),
        "region",
        F.col("date").alias("open_date"),
        "units",
        "area",
    )
    names = list(HEADINGS["new_openings"])
    ties = (F.col(n).asc_nulls_last() for n in names if n != "open_date")
    return spread(rows, F.col("open_date").desc_nulls_last(), *ties)
