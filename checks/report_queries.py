"""The reports, screen by screen."""

from __future__ import annotations

from datetime import date

from checks.model import BANDS, REGIONS, SOLD, Model
from checks.registry import check
from checks.tables_sql import change, even, floor_price, number, ratio
from estatelens.plans import (
    deals,
    land_query,
    land_reports,
    macro,
    rooms,
    second_hand,
    stock,
    supply,
    volume_price,
)

PERIOD = (date(1996, 1, 1), date(2001, 6, 30))
MONTHS = ("1996-03", "2000-10")
MONTH = "1998-05"
AS_OF = date(1999, 6, 15)
YEAR = 1999
STOCK_DAY = date(2001, 7, 15)
STOCK_YEAR = 2001
SHORT = [f"{i:02d}" for i in range(20)]

IN_PERIOD = "BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'"
IN_MONTHS = "BETWEEN '1996-03' AND '2000-10'"
IN_REGIONS = "IN (" + ", ".join(f"'{r}'" for r in REGIONS) + ")"
IN_SHORT = "IN (" + ", ".join(f"'{r}'" for r in SHORT) + ")"
IN_BANDS = "IN (" + ", ".join(f"'{b}'" for b in BANDS) + ")"


# --- land parcels -----------------------------------------------------------
PARCELS = dict(
    listed=PERIOD, dealt=PERIOD, districts=REGIONS, locations=["BUILDING", "FURNITURE", "PATCHED"],
    min_area="20", max_area="",
)
PARCELS_SQL = f"""list_start {IN_PERIOD} AND deal_time {IN_PERIOD} AND district {IN_REGIONS}
    AND location IN ('BUILDING', 'FURNITURE', 'PATCHED') AND site_area BETWEEN 20 AND 100000000"""


@check("land_query_kpis",
       "listed_count:l listed_area listed_floor_price:d dealt_count:l dealt_area dealt_floor_price:d",
       f"""SELECT count(*) AS listed_count, {even('sum(site_area) / 10000', 1)} AS listed_area,
        {floor_price('start_price')} AS listed_floor_price,
        count(*) FILTER (deal_price > 0) AS dealt_count,
        {even('sum(site_area) FILTER (deal_price > 0) / 10000', 1)} AS dealt_area,
        {floor_price(where='deal_price > 0')} AS dealt_floor_price
        FROM land WHERE {PARCELS_SQL}""")
def _(m: Model):
    return land_query.land_query_kpis(m.land, **PARCELS)


@check("land_query_table",
       "status district parcel_name parcel_no location land_use:s list_start list_end "
       "terminate_date deal_time:date winner site_area_label far:s res_area com_area gfa:d2 "
       "start_price:d4 deal_price:d density green:s list_floor_price deal_floor_price:d",
       f"SELECT * FROM land WHERE {PARCELS_SQL}")
def _(m: Model):
    return land_query.land_query_table(m.land, **PARCELS)


# --- land report one --------------------------------------------------------
for kind in ("supply", "deal"):
    @check(f"land_{kind}_month_kpis", "month:s count:l area change_pct:d",
           f"""SELECT month, count, {even('area / 10000', 2)} AS area,
            {even('change * 100', 1)} AS change_pct
            FROM land_{kind}_month WHERE month = '{MONTH}'""")
    def _(m: Model, table=f"land_{kind}_month"):
        return land_reports.month_kpis(m.land_table(table), MONTH)


@check("land_ratio_monthly", "date month:s supply_deal_ratio:d", f"""
    SELECT date, month, {even('supply_deal_ratio', 1)} AS supply_deal_ratio
    FROM land_ratio_month WHERE month {IN_MONTHS}""")
def _(m: Model):
    return land_reports.land_ratio_monthly(m.land_table("land_ratio_month"), MONTHS)


@check("land_amount_mom", "date month:s value previous:d0 change:d",
       f"SELECT * FROM land_amount_month WHERE month {IN_MONTHS}")
def _(m: Model):
    return land_reports.land_change_monthly(m.land_table("land_amount_month"), MONTHS)


@check("land_area_count_monthly", "month:s site_area:d parcels:l", f"""
    SELECT month, sum(site_area) AS site_area, count(*) AS parcels FROM land
    WHERE deal_price > 0 AND month {IN_MONTHS} GROUP BY month""")
def _(m: Model):
    return land_reports.land_area_count_monthly(m.land, MONTHS)


@check("land_floor_price_mom", "date month:s value previous change:d",
       f"SELECT * FROM land_floor_month WHERE month {IN_MONTHS}")
def _(m: Model):
    return land_reports.land_change_monthly(m.land_table("land_floor_month"), MONTHS)


@check("land_floor_price_compare_monthly", "month:s floor_price res_floor_price:d",
       f"SELECT * FROM land_floor_pair_month WHERE month {IN_MONTHS}")
def _(m: Model):
    return land_reports.land_floor_price_compare_monthly(
        m.land_table("land_floor_pair_month"), MONTHS
    )


@check("land_res_supply_deal_monthly", "month:s supply deal ratio:d",
       f"SELECT * FROM land_residential_month WHERE month {IN_MONTHS}")
def _(m: Model):
    return land_reports.land_res_supply_deal_monthly(
        m.land_table("land_residential_month"), MONTHS
    )


RES_PROPER = "deal_price > 0 AND is_proper AND is_residential"


@check("land_res_gfa_far_monthly", "month:s gfa:d2 mean_far:d", f"""
    SELECT month, sum(gfa) AS gfa, {even('avg(max_far)', 2)} AS mean_far FROM land
    WHERE {RES_PROPER} AND month {IN_MONTHS} GROUP BY month""")
def _(m: Model):
    return land_reports.land_res_gfa_far_monthly(m.land, MONTHS)


# --- land report two --------------------------------------------------------
@check("land_floor_price_compare_yearly", "year:i floor_price res_floor_price:d",
       "SELECT * FROM land_floor_pair_year WHERE year >= 1997")
def _(m: Model):
    return land_reports.land_floor_price_compare_yearly(m.land_table("land_floor_pair_year"), 1997)


@check("land_res_supply_deal_yearly", "year:i supply deal ratio:d",
       "SELECT * FROM land_residential_year WHERE year >= 1997")
def _(m: Model):
    return land_reports.land_res_supply_deal_yearly(m.land_table("land_residential_year"), 1997)


@check("land_gfa_count_yearly", "year:s gfa:d2 parcels:l", """
    SELECT year(deal_time) AS year, sum(gfa) AS gfa, count(*) AS parcels FROM land
    WHERE deal_price > 0 AND year(deal_time) >= 1997 GROUP BY 1""")
def _(m: Model):
    return land_reports.land_gfa_count_yearly(m.land, 1997)


@check("land_res_gfa_far_yearly", "year:s gfa:d2 mean_far:d", f"""
    SELECT year(deal_time) AS year, sum(gfa) AS gfa, {even('avg(max_far)', 2)} AS mean_far
    FROM land WHERE {RES_PROPER} AND year(deal_time) >= 1997 GROUP BY 1""")
def _(m: Model):
    return land_reports.land_res_gfa_far_yearly(m.land, 1997)


@check("land_listed_area_yearly", "year:s site_area:d", """
    SELECT year(list_start) AS year, sum(site_area) AS site_area FROM land
    WHERE (land_use IS NULL OR land_use <> '5-LOW') AND year(list_start) >= 1997 GROUP BY 1""")
def _(m: Model):
    return land_reports.land_listed_area_yearly(m.land, 1997)


def _districts(value: str, where: str) -> str:
    return f"""SELECT district, value, value / nullif(sum(value) OVER (), 0) AS share FROM (
        SELECT district, {value} AS value FROM land WHERE {where} GROUP BY district)"""


COMMERCIAL_DEALS = f"deal_price > 0 AND is_commercial AND month = '{MONTH}'"


@check("land_district_amount_share", "district:s value:d2 share:d6",
       _districts("sum(deal_price)", COMMERCIAL_DEALS))
def _(m: Model):
    return land_reports.land_district_amount_share(m.land, MONTH)


@check("land_district_mean_price", "district:s value:d share:d6",
       _districts(even("avg(deal_price)", 2), COMMERCIAL_DEALS))
def _(m: Model):
    return land_reports.land_district_mean_price(m.land, MONTH)


@check("land_district_area_share", "district:s value:d share:d6",
       _districts("sum(site_area)", COMMERCIAL_DEALS))
def _(m: Model):
    return land_reports.land_district_area_share(m.land, MONTH)


@check("land_region_amount_mom", "short_region month:s value previous:d0 change:d", f"""
    SELECT * FROM land_district_amount WHERE short_region {IN_SHORT} AND month = '{MONTH}'""")
def _(m: Model):
    return land_reports.land_region_change(m.land_table("land_district_amount"), SHORT, MONTH)


@check("land_region_mean_mom", "short_region month:s value previous change:d", f"""
    SELECT * FROM land_district_mean WHERE short_region {IN_SHORT} AND month = '{MONTH}'""")
def _(m: Model):
    return land_reports.land_region_change(m.land_table("land_district_mean"), SHORT, MONTH)


@check("land_listed_area_monthly", "list_month:s site_area:d", f"""
    SELECT list_month, sum(site_area) AS site_area FROM land
    WHERE is_commercial AND list_month {IN_MONTHS} GROUP BY list_month""")
def _(m: Model):
    return land_reports.land_listed_area_monthly(m.land, MONTHS)


@check("land_listed_area_by_district", "district:s value:d share:d6",
       _districts("sum(site_area)", f"is_commercial AND list_month {IN_MONTHS}"))
def _(m: Model):
    return land_reports.land_listed_area_by_district(m.land, MONTHS)


# --- land report three ------------------------------------------------------
STRUCTURE = {
    "land_structure_commercial": (
        "is_commercial", lambda m: land_reports.land_structure_commercial(m.land, MONTHS)),
    "land_structure_commercial_proper": (
        "is_commercial AND is_proper",
        lambda m: land_reports.land_structure_commercial(m.land, MONTHS, proper=True)),
    "land_structure_residential": (
        "is_residential", lambda m: land_reports.land_structure_residential(m.land, MONTHS)),
    "land_structure_residential_proper": (
        "is_residential AND is_proper",
        lambda m: land_reports.land_structure_residential(m.land, MONTHS, proper=True)),
}
for name, (where, build) in STRUCTURE.items():
    check(name, "month:s site_area:d gfa:d2 floor_price:d", f"""
        SELECT month, sum(site_area) AS site_area, sum(gfa) AS gfa,
            {floor_price()} AS floor_price
        FROM land WHERE deal_price > 0 AND month {IN_MONTHS} AND {where} GROUP BY month""")(build)

MIX = {
    "land_use_mix": (
        "com_area res_area:d2", "TRUE", lambda m: land_reports.land_use_mix(m.land, MONTHS)),
    "land_use_mix_proper": (
        "com_area res_area:d2", "is_proper",
        lambda m: land_reports.land_use_mix(m.land, MONTHS, proper=True)),
    "land_res_area_proper": (
        "res_area:d2", "is_proper", lambda m: land_reports.land_res_area_proper(m.land, MONTHS)),
    "land_com_area_proper": (
        "com_area:d2", "is_proper", lambda m: land_reports.land_com_area_proper(m.land, MONTHS)),
}
for name, (measures, where, build) in MIX.items():
    check(name, "month:s " + measures, f"""
        SELECT month, sum(com_area) AS com_area, sum(res_area) AS res_area
        FROM land WHERE deal_price > 0 AND month {IN_MONTHS} AND {where} GROUP BY month""")(build)


@check("land_open_listings",
       "district parcel_name parcel_no land_use:s list_start list_end:date site_area:d "
       "start_price:d4", """
    SELECT * FROM land WHERE NOT (deal_price > 0) AND list_end >= DATE '1999-06-15' - 15""")
def _(m: Model):
    return land_reports.land_open_listings(m.land, AS_OF)


# --- rooms ------------------------------------------------------------------
ROOMS_SQL = "area BETWEEN 0 AND 45"


@check("room_kpis", "supplied sold:l sold_area:d", f"""
    SELECT count(*) AS supplied, count(*) FILTER (status IN ('A', 'R')) AS sold,
        {even("coalesce(sum(area) FILTER (status IN ('A', 'R')), 0) / 10000", 2)} AS sold_area
    FROM rooms WHERE {ROOMS_SQL}""")
def _(m: Model):
    return rooms.room_kpis(m.rooms, sold_statuses=SOLD, max_area="45")


@check("room_table",
       "promo_name record_name:s sale_date:date building room_no status:s area:d "
       "unit_price total_price:d4",
       f"SELECT * FROM rooms WHERE {ROOMS_SQL} AND status IN ('A', '暂无数据')")
def _(m: Model):
    return rooms.room_table(m.rooms, max_area="45", statuses=["A", "暂无数据"])


# --- deals of new homes -----------------------------------------------------
CHOICE = dict(regions=REGIONS, period=PERIOD, min_area=1000, max_area=40_000)
DEALS_SQL = f"date {IN_PERIOD} AND region {IN_REGIONS} AND category = '住宅' AND unit_area <= 40000"


@check("deal_kpis", "units:l area price:d", f"""
    SELECT sum(units) AS units,
        {even('sum(area) FILTER (unit_area > 1000) / 10000', 2)} AS area,
        {even('''sum(CAST(area AS DOUBLE) * res_price) FILTER (unit_area > 1000 AND res_price > 0)
        / sum(area) FILTER (unit_area > 1000 AND res_price > 0) / 10000''', 2)} AS price
    FROM deal_view WHERE {DEALS_SQL} AND unit_area >= 1000""")
def _(m: Model):
    return deals.deal_kpis(m.deals, category="住宅", **CHOICE)


@check("deal_table", "promo_name record_name region:s units:l area:d price_label:s", f"""
    SELECT promo_name, record_name, region, sum(units) AS units, sum(area) AS area,
        coalesce({number(even('avg(res_price)'))}, '暂无数据') AS price_label
    FROM deal_view WHERE date {IN_PERIOD} AND region {IN_REGIONS}
        AND category IN ('住宅', '其他') AND unit_area <= 40000 AND unit_area > 1000
    GROUP BY ALL""")
def _(m: Model):
    return deals.deal_table(m.deals, category=["住宅", "其他"], **CHOICE)


# --- supply of new homes ----------------------------------------------------
SUPPLY_SQL = f"open_date {IN_PERIOD} AND region {IN_REGIONS} AND unit_area BETWEEN 1000 AND 40000"
ALL_DAYS = (date(1995, 1, 1), date(2002, 12, 31))
SUPPLY_CHOICE = dict(regions=REGIONS, period=ALL_DAYS, min_area="1000", max_area="40000")
SUPPLY_ALL_SQL = SUPPLY_SQL.replace("1996-01-01", "1995-01-01").replace("2001-06-30", "2002-12-31")


@check("supply_kpis", "supply for_sale:l on_sale_area:d2", f"""
    SELECT sum(supply) AS supply, sum(for_sale) AS for_sale, sum(on_sale_area) AS on_sale_area
    FROM supply_view WHERE {SUPPLY_ALL_SQL}""")
def _(m: Model):
    return supply.supply_kpis(m.supply, **SUPPLY_CHOICE)


@check("supply_table",
       "promo_name record_name region:s supply for_sale:i on_sale_area:d2 sell_through_label "
       "res_price_label com_price_label:s", f"""
    SELECT * REPLACE (on_sale_area * 10000 AS on_sale_area) FROM supply_labelled
    WHERE {SUPPLY_ALL_SQL} AND for_sale > 0 AND promo_name IN ('Brand#2', 'Brand#3', '暂无数据')""")
def _(m: Model):
    return supply.supply_table(
        m.supply, promo_names=["Brand#2", "Brand#3", "暂无数据"], **SUPPLY_CHOICE
    )


# --- supply and sale --------------------------------------------------------
@check("supply_sale_kpis", "supply for_sale:l on_sale_area:d sold_units:l sold_area:d", f"""
    WITH s AS (SELECT sum(total_units - non_sale) FILTER (unit_area <= 40000) AS supply,
        sum(for_sale) FILTER (unit_area <= 40000) AS for_sale,
        {even('sum(CAST(area AS DOUBLE) / total_units * for_sale) / 10000', 1)} AS on_sale_area
        FROM supply_view WHERE open_date BETWEEN DATE '1995-01-01' AND DATE '2002-12-31'
            AND region {IN_REGIONS} AND unit_area >= 1000),
    d AS (SELECT sum(units) AS sold_units, {even('sum(area) / 10000', 1)} AS sold_area
        FROM deal_view WHERE date BETWEEN DATE '1995-01-01' AND DATE '2002-12-31'
            AND region {IN_REGIONS} AND unit_area BETWEEN 1000 AND 40000)
    SELECT s.*, d.* FROM s, d""")
def _(m: Model):
    return supply.supply_sale_kpis(m.supply, m.deals, **SUPPLY_CHOICE)


CUTOFF = f"date <= DATE '2001-07-15' AND region {IN_REGIONS} AND band {IN_BANDS}"
STOCK = "coalesce(sum(total_units - non_sale), 0) - coalesce(sum(units), 0)"
SUPPLY_RATIO = even(ratio("sum(total_units - non_sale)", "sum(units)"), 2)


@check("stock_kpis", "stock:l stock_area:d", f"""
    SELECT {STOCK} AS stock,
        {even(f"{ratio('sum(area_y)', 'sum(total_units)')} * ({STOCK}) / 10000", 1)} AS stock_area
    FROM stock_view WHERE {CUTOFF}""")
def _(m: Model):
    return stock.stock_kpis(m.stock, regions=REGIONS, bands=BANDS, cutoff=STOCK_DAY)


@check("ratio_gauge", "ratio:d", f"""
    SELECT {SUPPLY_RATIO} AS ratio FROM region_band_ratio
    WHERE date {IN_PERIOD} AND region {IN_REGIONS} AND band {IN_BANDS}""")
def _(m: Model):
    return stock.ratio_gauge(m.band_ratio, regions=REGIONS, bands=BANDS, period=PERIOD)


@check("ratio_monthly", "month:s ratio:d", f"""
    SELECT strftime(date, '%Y-%m') AS month,
        {even(ratio('coalesce(sum(total_units - non_sale), 0)', 'coalesce(sum(units), 0)'), 2)}
            AS ratio
    FROM region_band_ratio WHERE date {IN_PERIOD} AND region {IN_REGIONS} AND band {IN_BANDS}
    GROUP BY 1""")
def _(m: Model):
    return stock.ratio_monthly(m.band_ratio, regions=REGIONS, bands=BANDS, period=PERIOD)


@check("ratio_by_region", "short_region:s ratio:d", f"""
    SELECT short_region,
        {even(ratio('coalesce(sum(total_units - non_sale), 0)', 'coalesce(sum(units), 0)'), 2)}
            AS ratio
    FROM stock_view WHERE date {IN_PERIOD} GROUP BY short_region""")
def _(m: Model):
    return stock.ratio_by_region(m.stock, period=PERIOD)


@check("stock_by_region", "short_region:s stock:l",
       f"SELECT short_region, {STOCK} AS stock FROM stock_view WHERE year <= {STOCK_YEAR} GROUP BY 1")
def _(m: Model):
    return stock.stock_by_region(m.stock, STOCK_YEAR)


@check("stock_by_band", "band:s stock:l share:d6", f"""
    SELECT *, stock / sum(stock) OVER () AS share FROM (
        SELECT band, {STOCK} AS stock FROM stock_view WHERE year <= {STOCK_YEAR} GROUP BY band)""")
def _(m: Model):
    return stock.stock_by_band(m.stock, STOCK_YEAR)


# --- sell-through, volume and price -----------------------------------------
@check("sell_through_by_region", "short_region:s sell_through:d6", f"""
    SELECT short_region, {ratio('coalesce(sum(units), 0)',
        'coalesce(sum(total_units), 0) - coalesce(sum(non_sale), 0)')} AS sell_through
    FROM ratio_view WHERE date <= DATE '2001-06-30' GROUP BY short_region""")
def _(m: Model):
    return volume_price.sell_through_by_region(m.ratio, STOCK_DAY)


@check("units_by_band", "band:s units:l share:d6", f"""
    SELECT band, sum(units) AS units, sum(units) / sum(sum(units)) OVER () AS share
    FROM deal_view WHERE date {IN_PERIOD} GROUP BY band""")
def _(m: Model):
    return volume_price.units_by_band(m.deals, period=PERIOD)


PRICED = f"""SELECT year(date) AS year, sum(units) AS units,
    sum(CAST(area AS DOUBLE) * res_price) / sum(area) AS price
    FROM deal_view WHERE res_price > 0 AND region {IN_REGIONS} GROUP BY 1"""


@check("price_yearly", "year:i units:l price:d4", PRICED)
def _(m: Model):
    return volume_price.price_yearly(m.deals, regions=REGIONS)


@check("price_yearly_change", "year:i price:d4 change:d",
       f"SELECT year, price, {change('price', 'year')} AS change FROM ({PRICED})")
def _(m: Model):
    return volume_price.price_yearly_change(m.deals, regions=REGIONS)


@check("new_openings", "record_name promo_name region:s open_date:date units:i area:d2", """
    SELECT record_name, coalesce(promo_name, '暂无数据') AS promo_name, region,
        date AS open_date, units, area
    FROM projects WHERE date >= DATE '1999-06-01'""")
def _(m: Model):
    return volume_price.new_openings(m.projects, AS_OF)


# --- second-hand homes ------------------------------------------------------
@check("second_hand_by_region", "region:s units:l area:d2", f"""
    SELECT region, sum(units) AS units, sum(area) * 10000 AS area FROM second_hand
    WHERE month = '{MONTH}' AND region {IN_REGIONS} GROUP BY region""")
def _(m: Model):
    return second_hand.second_hand_by_region(m.second_hand, MONTH, REGIONS)


@check("second_hand_units_series", "region date month:s units:l",
       f"SELECT * FROM second_hand WHERE region {IN_REGIONS}")
def _(m: Model):
    return second_hand.second_hand_units_series(m.second_hand, REGIONS)


@check("second_hand_area_series", "region date month:s area:d2", f"""
    SELECT region, date, month, area * 10000 AS area FROM second_hand
    WHERE region {IN_REGIONS}""")
def _(m: Model):
    return second_hand.second_hand_area_series(m.second_hand, REGIONS)


# --- finance and income -----------------------------------------------------
@check("money_latest", "m1 m2:d6",
       "SELECT m1 / 10000 AS m1, m2 / 10000 AS m2 FROM money ORDER BY riqi DESC LIMIT 1")
def _(m: Model):
    return macro.money_latest(m.money)


@check("lending_latest", "rate_pct:d6",
       "SELECT rate * 100 AS rate_pct FROM lending_rate ORDER BY date DESC LIMIT 1")
def _(m: Model):
    return macro.lending_latest(m.lending_rate)


@check("reserve_latest", "large_pct small_medium_pct:d6", """
    SELECT large * 100 AS large_pct, small_medium * 100 AS small_medium_pct
    FROM reserve_ratio ORDER BY date DESC LIMIT 1""")
def _(m: Model):
    return macro.reserve_latest(m.reserve_ratio)


@check("income_latest", "urban rural:d", f"""
    SELECT {even('urban / 10000', 2)} AS urban, {even('rural / 10000', 2)} AS rural
    FROM income ORDER BY date DESC LIMIT 1""")
def _(m: Model):
    return macro.income_latest(m.income)


@check("cpi_latest", "national city:d6",
       "SELECT national, city FROM cpi_pair ORDER BY riqi DESC LIMIT 1")
def _(m: Model):
    return macro.cpi_latest(m.cpi_pair)


@check("income_yearly", "year:i urban rural:d2",
       "SELECT year(date) AS year, urban, rural FROM income")
def _(m: Model):
    return macro.income_yearly(m.income)


@check("income_by_region", "riqi:date year:i urban:d2", """
    SELECT riqi, year(riqi) AS year, urban FROM income_detail WHERE region = '03 NATION_3'""")
def _(m: Model):
    return macro.income_by_region(m.income_detail, "03 NATION_3")


@check("cpi_yearly", "riqi:date year:i national city:d6", """
    SELECT riqi, year(riqi) AS year, national, city FROM cpi_pair WHERE year(riqi) >= 1997""")
def _(m: Model):
    return macro.cpi_yearly(m.cpi_pair, 1997)


@check("reserve_series", "date:date large small_medium:d6",
       "SELECT date, large, small_medium FROM reserve_ratio WHERE year(date) >= 1997")
def _(m: Model):
    return macro.reserve_series(m.reserve_ratio, 1997)


@check("lending_series", "date:date rate:d6", "SELECT date, rate FROM lending_rate")
def _(m: Model):
    return macro.lending_series(m.lending_rate)


@check("loan_vs_m2", "date:date month:s loan m2:d2", """
    SELECT date, strftime(date, '%Y-%m') AS month, loan, m2 FROM cpi WHERE year(date) >= 1998""")
def _(m: Model):
    return macro.loan_vs_m2(m.cpi, 1998)


@check("money_yoy", "riqi:date month:s m1 m2:d2 m1_yoy m2_yoy:d", f"""
    SELECT riqi, strftime(riqi, '%Y-%m') AS month, m1, m2,
        {change('m1', 'riqi', rows=12)} AS m1_yoy, {change('m2', 'riqi', rows=12)} AS m2_yoy
    FROM money ORDER BY riqi DESC LIMIT 10""")
def _(m: Model):
    return macro.money_yoy(m.money)


# --- population and economy -------------------------------------------------
@check("city_population_kpis", "population:l urban_pct:d6", """
    SELECT population, urban_share * 100 AS urban_pct FROM city_population
    WHERE year(date) = 1999""")
def _(m: Model):
    return macro.city_population_kpis(m.city_population, YEAR)


TOTALS = ["00 NATION_0", "01 NATION_1"]


def _latest_share(value: str) -> str:
    return f"""SELECT substring(region, 1, 2) AS short_region, {value},
        {value} / sum({value}) OVER () AS share FROM people
        WHERE year(date) = (SELECT max(year(date)) FROM people)
            AND region NOT IN ('00 NATION_0', '01 NATION_1')"""


@check("population_by_region", "short_region:s population:l share:d6", _latest_share("population"))
def _(m: Model):
    return macro.population_by_region(m.people, TOTALS)


@check("population_growth", "region:s year:i population:l growth:d", f"""
    SELECT region, year(date) AS year, population,
        {change('population', by='region')} AS growth
    FROM people WHERE region = '03 NATION_3'""")
def _(m: Model):
    return macro.population_growth(m.people, "03 NATION_3")


@check("urban_share", "region:s urban_pct:d", f"""
    SELECT region, {even(ratio('urban_pop', 'population') + ' * 100')} AS urban_pct FROM people
    WHERE year(date) = 1999 AND region = '03 NATION_3'""")
def _(m: Model):
    return macro.urban_share(m.people, "03 NATION_3", YEAR)


@check("gdp_kpis", "gdp:d2 gdp_per_head:d", f"""
    SELECT gdp, {even(ratio('gdp * 10000', 'population'))} AS gdp_per_head
    FROM city_population WHERE year(date) = 1999""")
def _(m: Model):
    return macro.gdp_kpis(m.city_population, YEAR)


@check("gdp_by_region", "short_region:s gdp:d2 share:d6", _latest_share("gdp"))
def _(m: Model):
    return macro.gdp_by_region(m.people, TOTALS)


@check("gdp_series", "region:s date:date year:i gdp:d2", """
    SELECT region, date, year(date) AS year, gdp FROM people WHERE region = '03 NATION_3'""")
def _(m: Model):
    return macro.gdp_series(m.people, "03 NATION_3")
