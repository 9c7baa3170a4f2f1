"""Screens "land reports" one to three.

``months`` is a pair of month keys, both included. The functions that start
with a ready-made monthly table take the view of that table, all others take
the parcel view. Over a typed parcel table (``plans.parcels``) months and years
are asked for as ranges of days, which reach the scan; over parcels with dates
as texts they are compared as texts.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.constants import TEN_THOUSAND
from estatelens.functions import (
    between,
    count_rows,
    days_of,
    in_period,
    mean,
    member,
    positive,
    round_even,
    sum0,
    to_number,
    year_key,
)
from estatelens.operators import ascending, descending, spread, with_share
from estatelens.plans.land_months import floor_price
from estatelens.schemas import HEADINGS


# month column -> (day, folder of years) of a typed parcel table
_DAYS = {"month": ("deal_time", "deal_year"), "list_month": ("list_start", "list_year")}


def _typed(land: DataFrame) -> bool:
    return any(folder in land.columns for _, folder in _DAYS.values())


def _in_months(land: DataFrame, months: tuple[str, str], month: str = "month") -> Column:
    """The month lies in ``months``."""
    if not _typed(land):
        return between(month, months)
    day, folder = _DAYS[month]
    return in_period(land, day, days_of(months), folder)


def _in_month(land: DataFrame, month) -> Column:
    """The month of the deal is ``month``, or one of several."""
    if not _typed(land):
        return member("month", month)
    months = [month] if isinstance(month, str) else list(month)
    if not months:
        return F.lit(False)
    span = _in_months(land, (min(months), max(months)))
    return span if len(months) == 1 else span & member("month", months)


# --- report one: months -----------------------------------------------------
def month_kpis(report: DataFrame, month) -> DataFrame:
    """Count, area (10,000 ㎡) and change (%) of the chosen month.

    For listings and for transfers alike.
    """
    return report.where(member("month", month)).select(
        "month",
        "count",
        round_even(F.col("area") / TEN_THOUSAND, 2).alias("area"),
        round_even(F.col("change") * 100, 1).alias("change_pct"),
    )


def land_ratio_monthly(report: DataFrame, months: tuple[str, str]) -> DataFrame:
    return ascending(
        report.where(between("month", months)).select(
            "date", "month", round_even("supply_deal_ratio", 1).alias("supply_deal_ratio")
        ),
        "date",
    )


def land_change_monthly(report: DataFrame, months: tuple[str, str]) -> DataFrame:
    """Value, previous value and change per month (amounts or floor prices)."""
    return ascending(
        report.where(between("month", months)).select(
            "date", "month", "value", "previous", "change"
        ),
        "date",
    )


def land_floor_price_compare_monthly(report: DataFrame, months: tuple[str, str]) -> DataFrame:
    return ascending(
        report.where(between("month", months)).select("month", "floor_price", "res_floor_price"),
        "month",
    )


def land_res_supply_deal_monthly(report: DataFrame, months: tuple[str, str]) -> DataFrame:
    return ascending(
        report.where(between("month", months)).select("month", "supply", "deal", "ratio"),
        "month",
    )


def land_area_count_monthly(land: DataFrame, months: tuple[str, str]) -> DataFrame:
    """Area and number of transferred parcels per month."""
    dealt = land.where(_in_months(land, months) & positive("deal_price"))
    return ascending(
        dealt.groupBy("month").agg(
            sum0("site_area").alias("site_area"), count_rows().alias("parcels")
        ),
        "month",
    )


def _gfa_and_far(df: DataFrame, key: str) -> DataFrame:
    """Floor area, and the plain (not area-weighted) mean of the plot ratios."""
    return ascending(
        df.groupBy(key).agg(
            sum0("gfa").alias("gfa"),
            round_even(mean(to_number("max_far")), 2).alias("mean_far"),
        ),
        key,
    )


def _residential_proper_deals() -> Column:
    return positive("deal_price") & F.col("is_proper") & F.col("is_residential")


def land_res_gfa_far_monthly(land: DataFrame, months: tuple[str, str]) -> DataFrame:
    return _gfa_and_far(
        land.where(_residential_proper_deals() & _in_months(land, months)), "month"
    )


# --- report two: years and districts ----------------------------------------
def _years(report: DataFrame, first_year: int, *measures: str) -> DataFrame:
    year = F.year("date")
    return ascending(
        report.where(year >= first_year).select(year.alias("year"), *measures), "year"
    )


def land_floor_price_compare_yearly(report: DataFrame, first_year: int = 2018) -> DataFrame:
    return _years(report, first_year, "floor_price", "res_floor_price")


def land_res_supply_deal_yearly(report: DataFrame, first_year: int = 2018) -> DataFrame:
    return _years(report, first_year, "supply", "deal", "ratio")


def _since(land: DataFrame, day: str, first_year: int) -> DataFrame:
    """Rows from ``first_year`` on, with the year as text."""
    year = year_key(day)
    since = year >= str(first_year)
    if _typed(land):
        since = F.col(day) >= F.lit(date(first_year, 1, 1))
        folder = dict(_DAYS.values())[day]
        since = since & (F.col(folder) >= first_year) if folder in land.columns else since
    return land.where(since).withColumn("year", year)


def land_gfa_count_yearly(land: DataFrame, first_year: int = 2017) -> DataFrame:
    dealt = _since(land.where(positive("deal_price")), "deal_time", first_year)
    return ascending(
        dealt.groupBy("year").agg(sum0("gfa").alias("gfa"), count_rows().alias("parcels")),
        "year",
    )


def land_res_gfa_far_yearly(land: DataFrame, first_year: int = 2017) -> DataFrame:
    return _gfa_and_far(
        _since(land.where(_residential_proper_deals()), "deal_time", first_year), "year"
    )


def land_listed_area_yearly(land: DataFrame, first_year: int = 2017) -> DataFrame:
    listed = _since(land.where("is_commercial"), "list_start", first_year)
    return ascending(listed.groupBy("year").agg(sum0("site_area").alias("site_area")), "year")


def _by_district(rows: DataFrame, value: Column) -> DataFrame:
    """One value per district with its share, largest first."""
    districts = rows.groupBy("district").agg(value.alias("value"))
    return descending(with_share(districts, "value"), "value", "district")


def _commercial_deals(land: DataFrame, month) -> DataFrame:
    return land.where(
        positive("deal_price") & F.col("is_commercial") & _in_month(land, month)
    )


def land_district_amount_share(land: DataFrame, month) -> DataFrame:
    return _by_district(_commercial_deals(land, month), sum0("deal_price"))


def land_district_mean_price(land: DataFrame, month) -> DataFrame:
    """Mean price of a parcel, not of a square metre."""
    return _by_district(_commercial_deals(land, month), round_even(mean("deal_price"), 2))


def land_district_area_share(land: DataFrame, month) -> DataFrame:
    return _by_district(_commercial_deals(land, month), sum0("site_area"))


def land_region_change(report: DataFrame, regions, month) -> DataFrame:
    """Value, previous value and change per region (amounts or mean prices).

    ``regions`` are short region names.
    """
    return report.where(member("short_region", regions) & member("month", month)).select(
        "short_region", "month", "value", "previous", "change"
    )


def _commercial_listings(land: DataFrame, months: tuple[str, str]) -> DataFrame:
    return land.where(F.col("is_commercial") & _in_months(land, months, "list_month"))


def land_listed_area_monthly(land: DataFrame, months: tuple[str, str]) -> DataFrame:
    return ascending(
        _commercial_listings(land, months)
        .groupBy("list_month").agg(sum0("site_area").alias("site_area")),
        "list_month",
    )


def land_listed_area_by_district(land: DataFrame, months: tuple[str, str]) -> DataFrame:
    return _by_district(_commercial_listings(land, months), sum0("site_area"))


# --- report three: structure of the transfers -------------------------------
def _structure(
    land: DataFrame, months: tuple[str, str], proper: bool, uses: str | None, **measures: Column
) -> DataFrame:
    rows = land.where(positive("deal_price") & _in_months(land, months))
    if uses:
        rows = rows.where(uses)
    if proper:
        rows = rows.where("is_proper")
    return ascending(
        rows.groupBy("month").agg(*(m.alias(name) for name, m in measures.items())), "month"
    )


def _area_and_price(land, months, proper, uses) -> DataFrame:
    return _structure(
        land, months, proper, uses,
        site_area=sum0("site_area"), gfa=sum0("gfa"), floor_price=floor_price(),
    )


def land_structure_commercial(land, months, *, proper: bool = False) -> DataFrame:
    return _area_and_price(land, months, proper, "is_commercial")


def land_structure_residential(land, months, *, proper: bool = False) -> DataFrame:
    return _area_and_price(land, months, proper, "is_residential")


def land_use_mix(land, months, *, proper: bool = False) -> DataFrame:
    return _structure(
        land, months, proper, None, com_area=sum0("com_area"), res_area=sum0("res_area")
    )


def land_res_area_proper(land, months) -> DataFrame:
    return _structure(land, months, True, None, res_area=sum0("res_area"))


def land_com_area_proper(land, months) -> DataFrame:
    return _structure(land, months, True, None, com_area=sum0("com_area"))


def land_open_listings(land: DataFrame, as_of: date | None = None, days: int = 15) -> DataFrame:
    """Parcels not transferred whose listing ended at most ``days`` ago.

    A parcel without any price is neither sold nor unsold and is left out.
    """
    oldest = F.date_sub(F.lit(as_of or date.today()), days)
    still_open = ~positive("deal_price") & (F.col("list_end") >= oldest)
    return spread(
        land.where(still_open).select(*HEADINGS["land_open_listings"]),
        F.col("list_start").desc_nulls_last(),
        F.col("list_end").desc_nulls_last(),
        F.col("parcel_no").asc_nulls_last(),
    )
