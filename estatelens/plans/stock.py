"""Screen "supply and sale": stock and supply/sale ratios."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.constants import TEN_THOUSAND
from estatelens.functions import (
    between,
    last_days,
    member,
    month_key,
    ratio,
    ratio_of_sums,
    round_even,
    sum0,
)
from estatelens.operators import ascending, descending, with_share


def for_sale_total() -> Column:
    """Units that were ever for sale, summed row by row."""
    return F.col("total_units") - F.col("non_sale")


def stock_units() -> Column:
    return sum0(for_sale_total()) - sum0("units")


def supply_sale_ratio() -> Column:
    return round_even(ratio_of_sums(for_sale_total(), "units"), 2)


def stock_kpis(
    stock: DataFrame, *, regions, bands, cutoff: date | None = None
) -> DataFrame:
    """Units and area (10,000 ㎡) in stock at the end of ``cutoff``."""
    cutoff = cutoff or date.today() - timedelta(days=1)
    area = ratio(sum0("area_y"), sum0("total_units")) * stock_units().cast("double")
    return stock.where(
        (F.col("date") <= F.lit(cutoff)) & member("region", regions) & member("band", bands)
    ).agg(
        stock_units().alias("stock"),
        round_even(area / TEN_THOUSAND, 1).alias("stock_area"),
    )


def _ratio_rows(ratios: DataFrame, regions, bands, period, as_of) -> DataFrame:
    return ratios.where(
        between("date", period or last_days(60, as_of))
        & member("region", regions)
        & member("band", bands)
    )


def ratio_gauge(ratios: DataFrame, *, regions, bands, period=None, as_of=None) -> DataFrame:
    """Units supplied per unit sold."""
    return _ratio_rows(ratios, regions, bands, period, as_of).agg(
        supply_sale_ratio().alias("ratio")
    )


def ratio_monthly(ratios: DataFrame, *, regions, bands, period=None, as_of=None) -> DataFrame:
    rows = _ratio_rows(ratios, regions, bands, period, as_of)
    return ascending(
        rows.groupBy(month_key("date").alias("month")).agg(supply_sale_ratio().alias("ratio")),
        "month",
    )


def ratio_by_region(stock: DataFrame, *, period=None, as_of=None) -> DataFrame:
    rows = stock.where(between("date", period or last_days(180, as_of)))
    return descending(
        rows.groupBy("short_region").agg(supply_sale_ratio().alias("ratio")),
        "ratio", "short_region",
    )


def stock_by_region(stock: DataFrame, year: int) -> DataFrame:
    """Stock per region at the end of ``year``."""
    return descending(
        stock.where(F.col("date") <= F.lit(date(year, 12, 31)))
        .groupBy("short_region").agg(stock_units().alias("stock")),
        "stock", "short_region",
    )


def stock_by_band(stock: DataFrame, year: int) -> DataFrame:
    """Stock per size band at the end of ``year``, with its share."""
    bands = stock.where(F.col("date") <= F.lit(date(year, 12, 31))).groupBy("band").agg(stock_units().alias("stock"))
    return descending(with_share(bands, "stock"), "stock", "band")
