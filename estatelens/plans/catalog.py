"""All report views over stored tables, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from estatelens.plans import views
from estatelens.sources import register_views


def _as_stored(table: DataFrame) -> DataFrame:
    return table


# view name -> (stored table, how the view is derived from it)
VIEWS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "ratios": ("region_ratio", views.region_ratio_view),
    "band_ratios": ("region_band_ratio", views.band_ratio_view),
    "stock": ("region_band_stock", views.stock_view),
    "deals": ("deal_list", views.deal_view),
    "supply": ("history_supply", views.supply_view),
    "projects": ("project_name", views.project_view),
    "rooms": ("room", views.room_view),
    "land": ("land", views.land_view),
    "second_hand": ("second_hand", views.second_hand_view),
    "land_supply_month": ("land_supply_month", views.land_month_view),
    "land_deal_month": ("land_deal_month", views.land_month_view),
    "land_ratio_month": ("land_ratio_month", views.land_ratio_view),
    "land_amount_month": ("land_amount_month", views.land_month_view),
    "land_floor_month": ("land_floor_month", views.land_month_view),
    "land_floor_pair_month": ("land_floor_pair_month", views.land_month_view),
    "land_residential_month": ("land_residential_month", views.land_month_view),
    "land_floor_pair_year": ("land_floor_pair_year", views.land_year_view),
    "land_residential_year": ("land_residential_year", views.land_year_view),
    "land_district_amount": ("land_district_amount", views.land_month_view),
    "land_district_mean": ("land_district_mean", views.land_month_view),
    "money": ("money", _as_stored),
    "reserve_ratio": ("reserve_ratio", _as_stored),
    "lending_rate": ("lending_rate", _as_stored),
    "income": ("income", _as_stored),
    "income_detail": ("income_detail", _as_stored),
    "cpi_pair": ("cpi_pair", _as_stored),
    "cpi": ("cpi", _as_stored),
    "city_population": ("city_population", _as_stored),
    "people": ("people", _as_stored),
}


def open_views(
    read: Callable[[str], DataFrame], names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """The views, each over ``read(table)``; lazy, nothing is loaded.

    ``read`` is one of the readers with its connection filled in, such as
    ``partial(read_parquet, spark, root)``.
    """
    return {n: VIEWS[n][1](read(VIEWS[n][0])) for n in names or VIEWS}


def register(
    read: Callable[[str], DataFrame], names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """As :func:`open_views`, and known to ``spark.sql`` under their names."""
    opened = open_views(read, names)
    register_views(opened)
    return opened
