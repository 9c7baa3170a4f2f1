"""Pipeline steps, views and single operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.model import BANDS, RULES, Model
from checks.registry import check
from checks.tables_sql import change, even, ratio
from estatelens.functions import (
    between,
    choice,
    first_of_month,
    last_days,
    last_of_previous_month,
    member,
    month_key,
    not_member,
    positive,
    ratio_of_sums,
    sum0,
    sum_strict,
    weighted_mean,
    within,
)
from estatelens.operators import (
    change_by_calendar,
    change_from_previous,
    latest_row,
    newest_then_ascending,
    pivot_series,
    sorted_values,
    with_category,
    with_share,
)
from estatelens.plans import etl, macro, pickers, stock
from estatelens.schemas import HISTORY_SUPPLY

AS_OF = date(1999, 6, 15)
STOCK_DAY = date(2001, 7, 15)
SALE = "region permit record_name category_raw:s units:i area:d date:date"


# --- pipeline steps ---------------------------------------------------------
@check("band_assign", SALE + " band:s", """
    SELECT region, permit, record_name, category_raw, units, area, date,
        CASE WHEN area / units < 1000 THEN 'b1' WHEN area / units <= 1500 THEN 'b2'
             WHEN area / units <= 2500 THEN 'b3' WHEN area / units <= 5000 THEN 'b4'
             ELSE 'b5' END AS band
    FROM sale_daily WHERE units > 0""")
def _(m: Model):
    return etl.banded(m.sale_daily, "units", RULES)


@check("category_map_sale", SALE + " category:s", "SELECT * FROM sales_categorised")
def _(m: Model):
    return etl.sales_with_category(m.sale_daily, RULES)


@check("category_map_room", "permit record_name remark:s area total_price:d category:s",
       "SELECT * FROM rooms_categorised")
def _(m: Model):
    return etl.rooms_with_category(m.room_price, RULES)


@check("category_map_table", "permit category_raw category:s", """
    SELECT permit, category_raw, coalesce(t.r_name, 'none') AS category
    FROM sale_daily LEFT JOIN (SELECT 'ECONOMY' AS raw, r_name FROM region WHERE r_regionkey = 1
        UNION ALL SELECT 'SMALL', r_name FROM region WHERE r_regionkey = 2) t
    ON category_raw = t.raw""")
def _(m: Model):
    raw = F.when(F.col("r_regionkey") == 1, "ECONOMY").when(F.col("r_regionkey") == 2, "SMALL")
    mapping = m.read("region").select(raw.alias("raw"), F.col("r_name").alias("category"))
    return with_category(m.sale_daily, "category_raw", mapping.dropna(), "none")


SUPPLY = "permit record_name region:s open_date:date area:d total_units for_sale non_sale:i res_price com_price:d"


@check("dedup_keep_last", SUPPLY, "SELECT * FROM supply_last")
def _(m: Model):
    return m.supply_last


@check("room_mean_price", "permit record_name category:s mean_price:d4", "SELECT * FROM mean_price")
def _(m: Model):
    return etl.mean_room_price(m.room_price, RULES)


@check("sale_price_join", SALE + " category:s mean_price:d4", """
    SELECT s.*, p.mean_price FROM sales_categorised s LEFT JOIN mean_price p
    ON s.permit = p.permit AND s.record_name = p.record_name AND s.category = p.category""")
def _(m: Model):
    sales = etl.sales_with_category(m.sale_daily, RULES)
    return etl.with_mean_price(sales, etl.mean_room_price(m.room_price, RULES))


@check("promo_join", SALE + " promo_name:s", """
    SELECT s.*, n.promo_name FROM sale_daily s
    LEFT JOIN promo n ON s.permit IS NOT DISTINCT FROM n.permit""")
def _(m: Model):
    return etl.with_promo_name(m.sale_daily, m.promo)


INFO = " delivery manager:s land_area:d volume far green presale:s"


@check("supply_info_join", SUPPLY + INFO, """
    SELECT s.*, i.* EXCLUDE (permit, record_name) FROM supply_last s LEFT JOIN info_last i
    ON s.permit IS NOT DISTINCT FROM i.permit
        AND s.record_name IS NOT DISTINCT FROM i.record_name""")
def _(m: Model):
    return etl.with_project_info(m.supply_last, m.project_info, RULES)


@check("deal_list",
       "region permit record_name:s units:i area:d date:date res_price:d promo_name category band:s",
       "SELECT * FROM deal_list")
def _(m: Model):
    return m.deal_list


_HISTORY = {"StringType": "s", "DateType": "date", "IntegerType": "i", "LongType": "l", "DecimalType": "d"}


@check("history_supply",
       " ".join(f"{f.name}:{_HISTORY[type(f.dataType).__name__]}" for f in HISTORY_SUPPLY),
       "SELECT * FROM history_supply")
def _(m: Model):
    return m.history_supply


@check("region_ratio", "date:date region:s units total_units for_sale non_sale:l",
       "SELECT * FROM region_ratio")
def _(m: Model):
    return m.region_ratio


@check("region_band_ratio", "date:date region band:s units total_units for_sale non_sale:l",
       "SELECT * FROM region_band_ratio")
def _(m: Model):
    return m.region_band_ratio


@check("region_band_stock",
       "date:date region band:s units:l area_x:d for_sale:l area_y:d total_units non_sale:l area:d",
       "SELECT * FROM region_band_stock")
def _(m: Model):
    return m.region_band_stock


# --- views ------------------------------------------------------------------
@check("view_deal",
       "region permit record_name:s units:i area:d date:date res_price:d promo_name category band:s "
       "unit_area:d",
       "SELECT * FROM deal_view")
def _(m: Model):
    return m.deals


@check("view_supply",
       "permit region record_name promo_name:s open_date:date total_units for_sale supply:i "
       "unit_area on_sale_area sell_through:d sell_through_label res_price_label com_price_label:s",
       "SELECT * FROM supply_labelled")
def _(m: Model):
    return m.supply


@check("view_room",
       "promo_name record_name:s sale_date:date building room_no status:s area:d "
       "unit_price total_price:d4 total_price_label:s", f"""
    SELECT *, CASE WHEN total_price IS NULL THEN '暂无数据' ELSE {
        "regexp_replace(CAST(CAST(total_price AS DECIMAL(38,4)) AS VARCHAR), '\\.?0+$', '')"
    } END AS total_price_label FROM rooms""")
def _(m: Model):
    return m.rooms


@check("view_land",
       "status district parcel_no location land_use:s list_start list_end terminate_date "
       "deal_time:date month list_month:s site_area list_floor_price deal_floor_price:d "
       "site_area_label:s is_proper is_residential is_commercial:b",
       "SELECT * FROM land")
def _(m: Model):
    return m.land


@check("view_stock",
       "date:date region short_region band:s year:i units:l area_x area_y:d total_units:l",
       "SELECT * FROM stock_view")
def _(m: Model):
    return m.stock


@check("view_months", "kind date month:s", """
    SELECT 'supply' AS kind, date, month FROM land_supply_month
    UNION ALL SELECT 'deal', date, month FROM land_deal_month
    UNION ALL SELECT 'ratio', date, month FROM land_ratio_month
    UNION ALL SELECT 'amount', date, month FROM land_amount_month
    UNION ALL SELECT 'second hand', date, month FROM second_hand""")
def _(m: Model):
    kinds = {
        "supply": m.land_table("land_supply_month"),
        "deal": m.land_table("land_deal_month"),
        "ratio": m.land_table("land_ratio_month"),
        "amount": m.land_table("land_amount_month"),
        "second hand": m.second_hand,
    }
    first, *rest = (df.select(F.lit(k).alias("kind"), "date", "month") for k, df in kinds.items())
    for df in rest:
        first = first.union(df)
    return first


# --- filters ----------------------------------------------------------------
@check("filter_optional", "parcel_no land_use location:s", """
    SELECT parcel_no, land_use, location FROM land
    WHERE location IN ('BUILDING', 'MACHINERY')""")
def _(m: Model):
    return m.land.where(
        choice("land_use", None) & choice("location", ["BUILDING", "MACHINERY"])
    )


@check("filter_not_in_keep_null", "parcel_no land_use:s", """
    SELECT parcel_no, land_use FROM land
    WHERE land_use IS NULL OR land_use NOT IN ('5-LOW', '2-HIGH')""")
def _(m: Model):
    return m.land.where(not_member("land_use", ["5-LOW", "2-HIGH"]))


@check("filter_minmax", "inclusive:b units:l rows:l", """
    SELECT TRUE AS inclusive, sum(units) AS units, count(*) AS rows FROM deal_view
        WHERE unit_area >= 1000 AND unit_area <= 50000
    UNION ALL SELECT FALSE, sum(units), count(*) FROM deal_view
        WHERE unit_area > 1000 AND unit_area <= 50000""")
def _(m: Model):
    def one(inclusive: bool):
        rows = m.deals.where(within("unit_area", "1000", "", (0, 50_000), inclusive=inclusive))
        return rows.agg(
            F.lit(inclusive).alias("inclusive"),
            F.sum("units").alias("units"),
            F.count(F.lit(1)).alias("rows"),
        )

    return one(True).union(one(False))


@check("filter_latest_year", "region:s date:date population:d", """
    SELECT region, date, population FROM people
    WHERE year(date) = (SELECT max(year(date)) FROM people)""")
def _(m: Model):
    return macro.latest_year(m.people)


@check("filter_relative_date", "kind:s rows:l", """
    SELECT 'month' AS kind, count(*) AS rows FROM sale_daily WHERE date >= DATE '1999-06-01'
    UNION ALL SELECT 'before', count(*) FROM sale_daily WHERE date <= DATE '1999-05-31'
    UNION ALL SELECT 'days', count(*) FROM sale_daily
        WHERE date >= DATE '1999-06-15' - 365 AND date <= DATE '1999-06-14'""")
def _(m: Model):
    conditions = {
        "month": F.col("date") >= first_of_month(AS_OF),
        "before": F.col("date") <= last_of_previous_month(AS_OF),
        "days": between("date", last_days(365, AS_OF)),
    }
    counts = m.sale_daily.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))
    return counts.unpivot([], list(conditions), "kind", "rows")


# --- aggregates -------------------------------------------------------------
@check("ratio_of_sums", "district:s floor_price:d4 factor:d4", f"""
    SELECT district, {ratio('coalesce(sum(deal_price), 0) * 10000',
                            'coalesce(sum(max_far * site_area), 0)')} AS floor_price,
        {ratio('sum(gfa)', 'sum(site_area)')} AS factor
    FROM land GROUP BY district""")
def _(m: Model):
    return m.land.groupBy("district").agg(
        ratio_of_sums("deal_price", F.col("max_far") * F.col("site_area"), 10_000)
        .alias("floor_price"),
        ratio_of_sums("gfa", "site_area").alias("factor"),
    )


@check("weighted_mean", "region:s price:d4", """
    SELECT region, sum(area * res_price) / nullif(sum(area), 0) AS price FROM (
        SELECT region, CAST(area AS DOUBLE) AS area, res_price FROM deal_list)
    GROUP BY region""")
def _(m: Model):
    return m.deals.groupBy("region").agg(weighted_mean("res_price", "area").alias("price"))


@check("strict_sum", "building:s plain strict:d", """
    SELECT building, coalesce(sum(raw), 0) AS plain,
        CASE WHEN count(raw) = count(*) THEN coalesce(sum(raw), 0) END AS strict
    FROM (SELECT building, nullif(area, 50) AS raw FROM rooms) GROUP BY building""")
def _(m: Model):
    area = F.nullif("area", F.lit(50.0))
    return m.rooms.groupBy("building").agg(
        sum0(area).alias("plain"), sum_strict(area).alias("strict")
    )


@check("sell_through", "region:s sell_through:d6", f"""
    SELECT region, {ratio('coalesce(sum(units), 0)',
        'coalesce(sum(total_units), 0) - coalesce(sum(non_sale), 0)')} AS sell_through
    FROM region_ratio GROUP BY region""")
def _(m: Model):
    return m.ratio.groupBy("region").agg(
        ratio_of_sums_difference().alias("sell_through")
    )


def ratio_of_sums_difference():
    from estatelens.functions import ratio as divide

    return divide(sum0("units"), sum0("total_units") - sum0("non_sale"))


@check("stock_asof", "region:s stock:l", """
    SELECT region, coalesce(sum(total_units - non_sale), 0) - coalesce(sum(units), 0) AS stock
    FROM region_band_stock WHERE date <= DATE '2001-07-15' GROUP BY region""")
def _(m: Model):
    rows = m.stock.where(F.col("date") <= F.lit(STOCK_DAY))
    return rows.groupBy("region").agg(stock.stock_units().alias("stock"))


STOCK = "coalesce(sum(total_units - non_sale), 0) - coalesce(sum(units), 0)"


@check("stock_area_asof", "stock:l stock_area:d", f"""
    SELECT {STOCK} AS stock, {even(
        f"{ratio('coalesce(sum(area_y), 0)', 'coalesce(sum(total_units), 0)')} * ({STOCK}) / 10000", 1
    )} AS stock_area
    FROM region_band_stock WHERE date <= DATE '2001-07-15'""")
def _(m: Model):
    regions = [f"{i:02d} NATION_{i}" for i in range(25)]
    return stock.stock_kpis(m.stock, regions=regions, bands=BANDS, cutoff=STOCK_DAY)


@check("share_of_whole", "district:s value:d2 share:d6", """
    SELECT district, sum(gfa) AS value, sum(gfa) / sum(sum(gfa)) OVER () AS share
    FROM land GROUP BY district""")
def _(m: Model):
    return with_share(m.land.groupBy("district").agg(sum0("gfa").alias("value")), "value")


@check("distinct_domain", "kind value:s", """
    SELECT DISTINCT 'district' AS kind, district AS value FROM land
    UNION ALL SELECT DISTINCT 'use', land_use FROM land
    UNION ALL SELECT DISTINCT 'month', month FROM land
        WHERE month > (SELECT min(month) FROM land)
    UNION ALL SELECT 'newest', max(list_month) FROM land""")
def _(m: Model):
    from estatelens.operators import distinct_values, newest_value

    parts = {
        "district": distinct_values(m.land, "district"),
        "use": distinct_values(m.land, "land_use"),
        "month": sorted_values(m.land, "month", drop_smallest=True),
        "newest": newest_value(m.land, "list_month"),
    }
    first, *rest = (df.select(F.lit(k).alias("kind"), F.col(df.columns[0]).alias("value"))
                    for k, df in parts.items())
    for df in rest:
        first = first.union(df)
    return first


# picker -> table, column and condition on its values in SQL
LISTS = {
    "land_district": ("land", "district"), "land_parcel_no": ("land", "parcel_no"),
    "land_location": ("land", "location"), "land_use": ("land", "land_use"),
    "land_deal_month": ("land", "month", "> (SELECT min(month) FROM land)"),
    "land_list_month": ("land", "list_month", "> (SELECT min(list_month) FROM land)"),
    "land_supply_month": ("land_supply_month", "month"),
    "land_district_month": ("land_district_amount", "month", "IS NOT NULL"),
    "land_short_region": ("land_district_amount", "substring(district, 1, 2)"),
    "room_promo_name": ("rooms", "promo_name"), "room_building": ("rooms", "building"),
    "room_status": ("rooms", "status"), "deal_region": ("deal_view", "region"),
    "deal_category": ("deal_view", "category"), "supply_region": ("supply_view", "region"),
    "supply_promo_name": ("supply_view", "promo_name"), "stock_region": ("stock_view", "region"),
    "stock_band": ("stock_view", "band"), "stock_year": ("stock_view", "year", "IS NOT NULL"),
    "ratio_region": ("region_band_ratio", "region"), "ratio_band": ("region_band_ratio", "band"),
    "second_hand_month": ("second_hand", "month"), "second_hand_region": ("second_hand", "region"),
    "income_region": ("income_detail", "region"), "people_region": ("people", "region"),
}
_ALL = ("land_short_region", "stock_band", "ratio_band", "second_hand_region")


def _chosen(name: str, column: str, table: str) -> str:
    if name in _ALL:
        return "TRUE"
    if name == "deal_category":  # of the values chosen at first, the only one that the test tables have
        return f"{column} = '住宅'"
    return f"{column} = (SELECT max({column}) FROM {table})" if name in ("stock_year", "second_hand_month") else "FALSE"


@check("picker_options", "picker value:s chosen:b", " UNION ALL ".join(
    f"""SELECT DISTINCT '{name}' AS picker, CAST({column} AS VARCHAR) AS value,
        coalesce({_chosen(name, column, table)}, FALSE) AS chosen
        FROM {table} {''.join(f'WHERE {column} {c}' for c in condition)}"""
    for name, (table, column, *condition) in LISTS.items()))
def _(m: Model):
    return pickers.all_options({
        "land": m.land, "rooms": m.rooms, "deals": m.deals, "supply": m.supply, "stock": m.stock,
        "band_ratios": m.band_ratio, "second_hand": m.second_hand, "income_detail": m.income_detail,
        "people": m.people, "land_supply_month": m.land_table("land_supply_month"),
        "land_district_amount": m.land_table("land_district_amount"),
    })


PIVOTED = {f"{i:02d} NATION_{i}": f"R{i}" for i in range(25)}


@check("pivot_series", f"month:s {' '.join(PIVOTED.values())}:l", f"""
    SELECT month, {", ".join(f"sum(units) FILTER (region = '{r}') AS {n}" for r, n in PIVOTED.items())}
    FROM second_hand GROUP BY month""")
def _(m: Model):
    names = PIVOTED
    wide = pivot_series(m.second_hand, "month", "region", list(names), F.sum("units"))
    return wide.withColumnsRenamed(names)


# --- changes, latest, top ---------------------------------------------------
@check("change_prev_row", "date:date gdp:d2 change:d", f"""
    SELECT date, gdp, {change('gdp')} AS change FROM city_population""")
def _(m: Model):
    return change_from_previous(m.city_population, "gdp", "date")


@check("change_12_rows", "riqi:date m1:d2 change:d", f"""
    SELECT riqi, m1, {change('m1', 'riqi', rows=12)} AS change FROM money""")
def _(m: Model):
    return change_from_previous(m.money, "m1", "riqi", rows=12)


@check("change_12_months", "riqi:date m1:d2 change:d", f"""
    SELECT a.riqi, a.m1, {even('a.m1 / nullif(b.m1, 0) - 1', 4)} AS change
    FROM money a LEFT JOIN money b ON a.riqi = b.riqi + INTERVAL 12 MONTH""")
def _(m: Model):
    return change_by_calendar(m.money, "m1", "riqi")


@check("growth_by_region", "region:s date:date population:l change:d", f"""
    SELECT region, date, population, {change('population', by='region')} AS change FROM people""")
def _(m: Model):
    return change_from_previous(m.people, "population", "date", by=["region"])


@check("period_over_period", "region month:s area previous:d4 change:d", f"""
    SELECT region, month, area, lag(area) OVER (PARTITION BY region ORDER BY month) AS previous,
        {change('area', 'month', 'region')} AS change FROM second_hand""")
def _(m: Model):
    return change_from_previous(
        m.second_hand, "area", "month", by=["region"], previous="previous"
    )


@check("latest_row", "riqi:date m1 m2:d2", "SELECT * FROM money ORDER BY riqi DESC LIMIT 1")
def _(m: Model):
    return latest_row(m.money, "riqi")


@check("top_n_then_ascending", "riqi:date m1 m2:d2", """
    SELECT * FROM (SELECT * FROM money ORDER BY riqi DESC LIMIT 10) ORDER BY riqi""")
def _(m: Model):
    return newest_then_ascending(m.money, "riqi", 10)
