"""Screens "finance and income", "population" and "economy".

The tables are short series: one row per month or year, some per region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.constants import TEN_THOUSAND, TOTAL_REGIONS
from estatelens.functions import member, month_key, not_member, ratio, round_even, short_name
from estatelens.operators import (
    ascending,
    change_by_calendar,
    change_from_previous,
    descending,
    latest_row,
    newest_then_ascending,
    with_share,
)


# --- finance and income: latest figures -------------------------------------
def money_latest(money: DataFrame) -> DataFrame:
    """M1 and M2 of the last month, in trillions (10,000 times the unit)."""
    return latest_row(money, "riqi").select(
        (F.col("m1") / TEN_THOUSAND).alias("m1"), (F.col("m2") / TEN_THOUSAND).alias("m2")
    )


def lending_latest(lending_rate: DataFrame) -> DataFrame:
    return latest_row(lending_rate, "date").select((F.col("rate") * 100).alias("rate_pct"))


def reserve_latest(reserve_ratio: DataFrame) -> DataFrame:
    return latest_row(reserve_ratio, "date").select(
        (F.col("large") * 100).alias("large_pct"),
        (F.col("small_medium") * 100).alias("small_medium_pct"),
    )


def income_latest(income: DataFrame) -> DataFrame:
    return latest_row(income, "date").select(
        round_even(F.col("urban") / TEN_THOUSAND, 2).alias("urban"),
        round_even(F.col("rural") / TEN_THOUSAND, 2).alias("rural"),
    )


def cpi_latest(cpi_pair: DataFrame) -> DataFrame:
    return latest_row(cpi_pair, "riqi").select("national", "city")


# --- finance and income: series ---------------------------------------------
def income_yearly(income: DataFrame) -> DataFrame:
    return ascending(income.select(F.year("date").alias("year"), "urban", "rural"), "year")


def income_by_region(income_detail: DataFrame, region) -> DataFrame:
    rows = income_detail.where(member("region", region))
    return ascending(rows.select("riqi", F.year("riqi").alias("year"), "urban"), "riqi")


def cpi_yearly(cpi_pair: DataFrame, first_year: int = 2013) -> DataFrame:
    rows = cpi_pair.where(F.year("riqi") >= first_year)
    return ascending(rows.select("riqi", F.year("riqi").alias("year"), "national", "city"), "riqi")


def reserve_series(reserve_ratio: DataFrame, first_year: int = 2015) -> DataFrame:
    rows = reserve_ratio.where(F.year("date") >= first_year)
    return ascending(rows.select("date", "large", "small_medium"), "date")


def lending_series(lending_rate: DataFrame) -> DataFrame:
    return ascending(lending_rate.select("date", "rate"), "date")


def loan_vs_m2(cpi: DataFrame, first_year: int = 2018) -> DataFrame:
    rows = cpi.where(F.year("date") >= first_year)
    return ascending(rows.select("date", month_key("date").alias("month"), "loan", "m2"), "date")


def money_yoy(money: DataFrame, *, newest: int = 10, calendar: bool = False) -> DataFrame:
    """M1 and M2 with their change over twelve rows, newest months only.

    With ``calendar`` the comparison is with the same month a year earlier,
    also where months are missing in between.
    """
    if calendar:
        rows = change_by_calendar(money, "m1", "riqi", change="m1_yoy")
        rows = change_by_calendar(rows, "m2", "riqi", change="m2_yoy")
    else:
        # a window over all rows at once: only over those that the newest need
        needed = money.orderBy(F.col("riqi").desc_nulls_last()).limit(newest + 12)
        rows = change_from_previous(needed, "m1", "riqi", rows=12, change="m1_yoy")
        rows = change_from_previous(rows, "m2", "riqi", rows=12, change="m2_yoy")
    rows = rows.select(
        "riqi", month_key("riqi").alias("month"), "m1", "m2", "m1_yoy", "m2_yoy"
    )
    return newest_then_ascending(rows, "riqi", newest)


# --- population and economy -------------------------------------------------
def _of_year(df: DataFrame, year: int) -> DataFrame:
    return df.where(F.year("date") == year)


def city_population_kpis(city: DataFrame, year: int = 2017) -> DataFrame:
    return _of_year(city, year).select(
        "population", (F.col("urban_share") * 100).alias("urban_pct")
    )


def gdp_kpis(city: DataFrame, year: int = 2017) -> DataFrame:
    """Total and per head."""
    per_head = ratio(F.col("gdp") * TEN_THOUSAND, "population")
    return _of_year(city, year).select("gdp", round_even(per_head).alias("gdp_per_head"))


def latest_year(df: DataFrame, day: str = "date") -> DataFrame:
    """Rows of the newest year in the whole table.

    In one pass: each task keeps the rows of its own newest year, and only those meet.
    """
    newest = Window.orderBy(F.year(day).desc())
    ranked = df.where(F.col(day).isNotNull()).withColumn("__newest", F.rank().over(newest))
    return ranked.where(F.col("__newest") == 1).drop("__newest")


def _by_region_latest(people: DataFrame, value: str, totals) -> DataFrame:
    rows = latest_year(people).where(not_member("region", totals))
    rows = rows.select(short_name("region").alias("short_region"), value)
    return descending(with_share(rows, value), value, "short_region")


def population_by_region(people: DataFrame, totals=TOTAL_REGIONS) -> DataFrame:
    return _by_region_latest(people, "population", totals)


def gdp_by_region(people: DataFrame, totals=TOTAL_REGIONS) -> DataFrame:
    return _by_region_latest(people, "gdp", totals)


def population_growth(people: DataFrame, region) -> DataFrame:
    rows = people.where(member("region", region)).select("region", "date", "population")
    grown = change_from_previous(rows, "population", "date", by=["region"], change="growth")
    return ascending(
        grown.select("region", F.year("date").alias("year"), "population", "growth"),
        "year", "region",
    )


def urban_share(people: DataFrame, region, year: int = 2017) -> DataFrame:
    percent: Column = round_even(ratio("urban_pop", "population") * 100)
    rows = _of_year(people, year).where(member("region", region))
    return rows.select("region", percent.alias("urban_pct"))


def gdp_series(people: DataFrame, region) -> DataFrame:
    rows = people.where(member("region", region))
    return ascending(rows.select("region", "date", F.year("date").alias("year"), "gdp"), "date", "region")
