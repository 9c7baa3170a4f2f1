"""The value lists behind the selection boxes of the screens."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.constants import CITY_PROPER, RESIDENTIAL
from estatelens.operators import distinct_values, domains, sorted_values


NEWEST, ALL = "newest", "all"


@dataclass(frozen=True)
class Picker:
    """Distinct values of one column of a view, as they come or sorted.

    ``chosen`` says what is chosen at first: nothing, some values, the newest (greatest) one,
    or all of them.
    """

    view: str
    column: str
    order: str | None = None
    drop_smallest: bool = False  # the empty text, in month lists
    chosen: str | Sequence[str] = ()


# fixed values: lists, and what is chosen in them at first
PICKERS: dict[str, Picker] = {
    "land_district": Picker("land", "district", chosen=[CITY_PROPER]),
    "land_parcel_no": Picker("land", "parcel_no"),
    "land_location": Picker("land", "location"),
    "land_use": Picker("land", "land_use"),
    "land_deal_month": Picker("land", "month", "up", drop_smallest=True, chosen=["2019-01"]),
    "land_list_month": Picker("land", "list_month", "up", drop_smallest=True, chosen=["2018-10", "2019-04"]),
    "land_supply_month": Picker("land_supply_month", "month", chosen=["2019-02"]),
    "land_district_month": Picker("land_district_amount", "month", "up", chosen=["2019-01"]),
    "land_short_region": Picker("land_district_amount", "short_region", chosen=ALL),
    "room_promo_name": Picker("rooms", "promo_name", chosen=["多弗绿城·翠湖里"]),
    "room_building": Picker("rooms", "building"),
    "room_status": Picker("rooms", "status"),
    "deal_region": Picker("deals", "region", chosen=["鹿城区"]),
    "deal_category": Picker("deals", "category", chosen=[RESIDENTIAL]),
    "supply_region": Picker("supply", "region", chosen=["鹿城区"]),
    "supply_promo_name": Picker("supply", "promo_name"),
    "stock_region": Picker("stock", "region", chosen=["鹿城区"]),
    "stock_band": Picker("stock", "band", chosen=ALL),
    "stock_year": Picker("stock", "year", "down", chosen=NEWEST),
    "ratio_region": Picker("band_ratios", "region", chosen=["鹿城区"]),
    "ratio_band": Picker("band_ratios", "band", chosen=ALL),
    "second_hand_month": Picker("second_hand", "month", chosen=NEWEST),
    "second_hand_region": Picker("second_hand", "region", chosen=ALL),
    "income_region": Picker("income_detail", "region", chosen=["全市"]),
    "people_region": Picker("people", "region", chosen=["全市"]),
}


def all_options(views: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> DataFrame:
    """(picker, value, chosen) of all lists, as texts, out of one pass over each view.

    A list with an order has no missing values, and some lists leave out their smallest one.
    ``chosen`` marks what is chosen at first; values that a list lacks are not chosen.
    Smallest and greatest values are one row for each list and are joined by broadcast.
    """
    pickers = {n: PICKERS[n] for n in names or PICKERS}
    by_view: dict[str, dict[str, str]] = {}
    for name, p in pickers.items():
        by_view.setdefault(p.view, {})[name] = p.column

    def listed(view: str, columns: dict[str, str]) -> DataFrame:
        # under the pickers' names, as one column may serve several
        return domains(views[view].select(*(F.col(c).alias(n) for n, c in columns.items())), columns)

    values = reduce(DataFrame.unionAll, (listed(v, c) for v, c in by_view.items()))
    ends = values.groupBy("name").agg(F.min("value").alias("least"), F.max("value").alias("newest"))
    joined = values.join(F.broadcast(ends), "name")

    def named(holds: Callable[[Picker], object]) -> Column:
        return F.col("name").isin([n for n, p in pickers.items() if holds(p)])

    left_out = (named(lambda p: p.order) & F.col("value").isNull()) | (
        named(lambda p: p.drop_smallest) & (F.col("value") == F.col("least"))
    )
    chosen = named(lambda p: p.chosen == ALL) | (named(lambda p: p.chosen == NEWEST) & (F.col("value") == F.col("newest")))
    for name, p in pickers.items():
        if not isinstance(p.chosen, str) and p.chosen:
            chosen |= (F.col("name") == name) & F.col("value").isin(list(p.chosen))
    return joined.where(~F.coalesce(left_out, F.lit(False))).select(
        F.col("name").alias("picker"), "value", F.coalesce(chosen, F.lit(False)).alias("chosen")
    )


def options(views: Mapping[str, DataFrame], name: str) -> DataFrame:
    """The values to choose from, out of views opened by the catalog."""
    picker = PICKERS[name]
    if picker.order is None:
        return distinct_values(views[picker.view], picker.column)
    return sorted_values(
        views[picker.view],
        picker.column,
        newest_first=picker.order == "down",
        drop_smallest=picker.drop_smallest,
    )
