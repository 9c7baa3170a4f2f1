"""Screens "supply of new homes" and the figures of "supply and sale"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.constants import HOME_AREA_BOUNDS, TEN_THOUSAND
from estatelens.functions import (
    choice,
    floor_bound,
    in_period,
    last_days,
    member,
    positive,
    ratio,
    round_even,
    sum0,
    sum_strict,
    within,
)
from estatelens.operators import side_by_side, spread
from estatelens.schemas import HEADINGS


def chosen_supply(
    supply: DataFrame,
    *,
    regions,
    period=None,
    promo_names=None,
    min_area=None,
    max_area=None,
    as_of=None,
) -> DataFrame:
    return supply.where(
        in_period(supply, "open_date", period or last_days(180, as_of))
        & member("region", regions)
        & choice("promo_name", promo_names)
        & within("unit_area", min_area, max_area, HOME_AREA_BOUNDS)
    )


def supply_kpis(supply: DataFrame, **choices) -> DataFrame:
    """Units supplied, units for sale, area for sale (10,000 ㎡).

    The area sums values that were rounded row by row.
    """
    return chosen_supply(supply, **choices).agg(
        sum0("supply").alias("supply"),
        sum0("for_sale").alias("for_sale"),
        sum0("on_sale_area").alias("on_sale_area"),
    )


def supply_table(supply: DataFrame, **choices) -> DataFrame:
    """Projects with homes for sale; the area is in ㎡ here."""
    rows = chosen_supply(supply, **choices).where(positive("for_sale"))
    rows = rows.withColumn("on_sale_area", F.col("on_sale_area") * TEN_THOUSAND)
    names = list(HEADINGS["supply_table"])
    ties = (F.col(n).asc_nulls_last() for n in names if n != "for_sale")
    return spread(rows.select(*names), F.col("for_sale").desc_nulls_last(), *ties)


def supply_sale_kpis(
    supply: DataFrame,
    deals: DataFrame,
    *,
    regions,
    period=None,
    min_area=None,
    max_area=None,
    as_of=None,
) -> DataFrame:
    """Supply and sale of one period in one row.

    The area for sale has a lower but no upper size bound, and is rounded once
    at the end; projects without any unit do not contribute to it.
    """
    period = period or last_days(180, as_of)
    inside = within("unit_area", min_area, max_area, HOME_AREA_BOUNDS)
    big_enough = floor_bound("unit_area", min_area, HOME_AREA_BOUNDS[0])
    on_sale = ratio("area", "total_units") * F.col("for_sale").cast("double")
    supplied = supply.where(
        in_period(supply, "open_date", period) & member("region", regions) & big_enough
    ).agg(
        sum_strict(F.col("total_units") - F.col("non_sale"), inside).alias("supply"),
        sum_strict("for_sale", inside).alias("for_sale"),
        round_even(sum0(on_sale) / TEN_THOUSAND, 1).alias("on_sale_area"),
    )
    sold = deals.where(in_period(deals, "date", period) & member("region", regions) & inside).agg(
        sum_strict("units").alias("sold_units"),
        round_even(sum0("area") / TEN_THOUSAND, 1).alias("sold_area"),
    )
    return side_by_side(supplied, sold)
