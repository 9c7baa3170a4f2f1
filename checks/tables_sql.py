"""The logical tables as SQL, for DuckDB.

``with_tables(names, body)`` puts the named tables, and the tables they read,
in front of a query.
"""

from __future__ import annotations

import re


def even(x: str, digits: int = 0) -> str:
    """Round half to even on doubles, without negative zero."""
    return f"(round_even(CAST({x} AS DOUBLE) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def number(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,4)) AS VARCHAR), '\\.?0+$', '')"


def band(area: str, units: str) -> str:
    size = ratio(area, units)
    return f"""CASE WHEN {units} = 0 AND {area} > 0 THEN 'b5'
        WHEN {size} < 1000 THEN 'b1' WHEN {size} <= 1500 THEN 'b2'
        WHEN {size} <= 2500 THEN 'b3' WHEN {size} <= 5000 THEN 'b4'
        WHEN {size} > 5000 THEN 'b5' END"""


def floor_price(price: str = "deal_price", where: str = "TRUE") -> str:
    return even(ratio(
        f"coalesce(sum({price}) FILTER ({where}), 0) * 10000",
        f"coalesce(sum(max_far * site_area) FILTER ({where}), 0)",
    ))


def change(value: str, order: str = "date", by: str = "", rows: int = 1) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return even(
        f"{value} / nullif(lag({value}, {rows}) OVER ({part}ORDER BY {order}), 0) - 1", 4
    )


TABLES: dict[str, str] = {
    "orders_region": """
        SELECT * REPLACE (lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ' ' || n_name AS n_name),
            CAST(o_orderdate AS DATE) AS o_date FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "lines": """
        SELECT * FROM lineitem JOIN orders_region ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey""",
    "sale_daily": """
        SELECT n_name AS region, CAST(l_partkey AS VARCHAR) AS permit,
            p_name || '（详细信息）' AS record_name, p_type AS category_raw,
            CAST(l_quantity AS INTEGER) AS units,
            CAST(l_extendedprice AS DECIMAL(10,2)) AS area, CAST(l_shipdate AS DATE) AS date
        FROM lines""",
    "supply_raw": """
        SELECT CAST(l_partkey AS VARCHAR) AS permit, p_name AS record_name, n_name AS region,
            o_date AS open_date, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS area,
            CAST(sum(l_quantity) AS INTEGER) AS total_units,
            CAST(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS INTEGER) AS for_sale,
            CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS INTEGER) AS non_sale,
            CAST(max(p_retailprice) AS DECIMAL(10,2)) AS res_price,
            CASE WHEN p_brand = 'Brand#2' THEN 0
                 ELSE CAST(max(p_retailprice) AS DECIMAL(10,2)) END AS com_price
        FROM lines GROUP BY l_partkey, p_name, p_brand, n_name, o_date""",
    "promo": """
        SELECT CAST(p_partkey AS VARCHAR) AS permit, nullif(p_brand, 'Brand#1') AS promo_name
        FROM part""",
    "room_price": """
        SELECT CAST(l_partkey AS VARCHAR) AS permit, p_name || '（详细信息）' AS record_name,
            p_type AS remark, CAST(nullif(l_quantity, 1) AS DECIMAL(18,4)) AS area,
            CAST(l_extendedprice AS DECIMAL(18,4)) AS total_price
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "project_info": """
        SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS permit, p_name AS record_name,
            lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS delivery,
            'M' || l_suppkey AS manager, CAST(p_retailprice AS DECIMAL(15,3)) AS land_area,
            p_type AS volume, CAST(p_size AS VARCHAR) AS far, p_brand AS green,
            'presale' AS presale
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # pipeline
    "sales_categorised": """
        SELECT *, CASE WHEN category_raw IN ('ECONOMY', 'SMALL') THEN '住宅'
            WHEN category_raw IN ('LARGE', 'PROMO') THEN '商业' ELSE '其他' END AS category
        FROM sale_daily""",
    "rooms_categorised": """
        SELECT *, CASE WHEN remark IN ('MEDIUM') THEN '其他'
            WHEN remark IN ('LARGE', 'PROMO') THEN '商业' ELSE '住宅' END AS category
        FROM room_price""",
    "mean_price": """
        SELECT permit, record_name, category, 
            CAST(sum(total_price) AS DOUBLE) / CAST(sum(area) AS DOUBLE) AS mean_price
        FROM rooms_categorised WHERE area IS NOT NULL AND total_price IS NOT NULL
        GROUP BY permit, record_name, category""",
    "deal_list": f"""
        SELECT s.region, s.permit, replace(s.record_name, '（详细信息）', '') AS record_name,
            s.units, s.area, s.date,
            CAST({even('p.mean_price', 2)} AS DECIMAL(10,2)) AS res_price, n.promo_name,
            s.category, {band('s.area', 's.units')} AS band
        FROM sales_categorised s
        LEFT JOIN mean_price p ON s.permit = p.permit AND s.record_name = p.record_name
            AND s.category = p.category
        LEFT JOIN promo n ON s.permit IS NOT DISTINCT FROM n.permit
        WHERE {band('s.area', 's.units')} IS NOT NULL""",
    "supply_last": """
        SELECT * FROM supply_raw QUALIFY row_number() OVER (
            PARTITION BY permit, record_name
            ORDER BY open_date DESC NULLS LAST, region DESC NULLS LAST) = 1""",
    "info_last": """
        SELECT * FROM project_info QUALIFY row_number() OVER (
            PARTITION BY permit, record_name ORDER BY delivery DESC NULLS LAST) = 1""",
    "history_supply": f"""
        SELECT s.*, n.promo_name, i.delivery, i.manager, i.land_area, i.volume, i.far, i.green,
            i.presale, {band('s.area', 's.total_units')} AS band
        FROM supply_last s
        LEFT JOIN info_last i ON s.permit IS NOT DISTINCT FROM i.permit
            AND s.record_name IS NOT DISTINCT FROM i.record_name
        LEFT JOIN promo n ON s.permit IS NOT DISTINCT FROM n.permit
        WHERE {band('s.area', 's.total_units')} IS NOT NULL""",
    "region_ratio": """
        WITH x AS (SELECT date, region, sum(units) AS units FROM deal_list GROUP BY ALL),
        g AS (SELECT open_date AS date, region, sum(total_units) AS total_units,
            sum(for_sale) AS for_sale, sum(non_sale) AS non_sale FROM supply_last GROUP BY ALL)
        SELECT date, region, units, total_units, for_sale, non_sale
        FROM x FULL JOIN g USING (date, region)""",
    "supply_banded": f"""
        SELECT *, {band('area', 'total_units')} AS band FROM supply_last""",
    "region_band_stock": f"""
        WITH x AS (SELECT date, region, band, sum(units) AS units, sum(area) AS area_x
            FROM deal_list GROUP BY date, region, band),
        g AS (SELECT open_date AS date, region, band, sum(total_units) AS total_units,
            sum(for_sale) AS for_sale, sum(non_sale) AS non_sale, sum(area) AS area
            FROM supply_banded WHERE band IS NOT NULL GROUP BY open_date, region, band)
        SELECT date, region, band, units, area_x, for_sale,
            {even(ratio('for_sale', 'total_units') + ' * CAST(area AS DOUBLE)', 2)} AS area_y,
            total_units, non_sale, area
        FROM x FULL JOIN g USING (date, region, band)""",
    "region_band_ratio": """
        SELECT date, region, band, units, total_units, for_sale, non_sale
        FROM region_band_stock""",
    # views
    "ratio_view": "SELECT *, substring(region, 1, 2) AS short_region FROM region_ratio",
    "stock_view": """
        SELECT *, substring(region, 1, 2) AS short_region, year(date) AS year
        FROM region_band_stock""",
    "deal_view": f"""
        SELECT * REPLACE (coalesce(promo_name, '暂无数据') AS promo_name),
            {ratio('area', 'units')} AS unit_area FROM deal_list""",
    "supply_view": f"""
        SELECT * REPLACE (coalesce(promo_name, '暂无数据') AS promo_name),
            {ratio('area', 'total_units')} AS unit_area,
            {even(ratio('area', 'total_units') + ' * for_sale / 10000', 2)} AS on_sale_area,
            total_units - non_sale AS supply,
            {even(ratio('total_units - non_sale - for_sale', 'total_units - non_sale'), 2)}
                AS sell_through,
            CASE WHEN res_price = 0 THEN '暂无数据' ELSE {number('res_price')} END
                AS res_price_label,
            CASE WHEN com_price = 0 THEN '暂无数据' ELSE {number('com_price')} END
                AS com_price_label
        FROM history_supply""",
    "supply_labelled": f"""
        SELECT *, {number(even('sell_through * 100'))} || '%' AS sell_through_label
        FROM supply_view""",
    "projects": """
        SELECT record_name, promo_name, region, open_date AS date, total_units AS units,
            CAST(area AS DOUBLE) AS area
        FROM supply_raw JOIN promo USING (permit)""",
    "rooms": f"""
        WITH raw AS (SELECT CAST(l_partkey AS VARCHAR) AS promo_name,
            nullif(CAST(l_orderkey AS VARCHAR), '7') AS record_name,
            CAST(l_shipdate AS DATE) AS sale_date, CAST(l_suppkey AS VARCHAR) AS building,
            CAST(l_linenumber AS VARCHAR) AS room_no, nullif(l_returnflag, 'N') AS status,
            nullif(l_quantity, 1) AS area, l_extendedprice / l_quantity AS unit_price
            FROM lineitem)
        SELECT promo_name, coalesce(record_name, '暂无数据') AS record_name, sale_date, building,
            room_no, coalesce(status, '暂无数据') AS status, coalesce(area, 0) AS area, unit_price,
            area * unit_price AS total_price
        FROM raw""",
    "land_raw": """
        WITH per_order AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS last_ship,
            sum(l_quantity) AS quantity, count(*) AS n_lines,
            sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS gfa,
            coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2)))
                FILTER (l_linestatus = 'F'), 0) AS res_area,
            coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2)))
                FILTER (l_linestatus = 'O'), 0) AS com_area
            FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderstatus AS status, n_name AS district, 'P' || o_orderkey AS parcel_name,
            CAST(o_orderkey AS VARCHAR) AS parcel_no, c_mktsegment AS location,
            nullif(o_orderpriority, '4-NOT SPECIFIED') AS land_use, o_date AS list_start,
            o_date + 30 AS list_end, CAST(NULL AS DATE) AS terminate_date,
            last_ship AS deal_time, c_name AS winner, nullif(quantity, 10) AS site_area,
            CAST(n_lines AS VARCHAR) AS far, CAST(n_lines AS DOUBLE) AS max_far,
            CAST(res_area AS DOUBLE) AS res_area, CAST(com_area AS DOUBLE) AS com_area,
            CAST(gfa AS DOUBLE) AS gfa, o_totalprice * CAST(0.9 AS DOUBLE) AS start_price,
            CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN 0 END AS deal_price,
            '30%' AS density, '20%' AS green, 'goRes(' || o_orderkey || ')' AS detail_url
        FROM orders_region JOIN per_order ON o_orderkey = l_orderkey""",
    "land": f"""
        SELECT * REPLACE (coalesce(site_area, 0) AS site_area,
                CASE WHEN detail_url = 'goRes(7)' THEN 'PATCHED' ELSE location END AS location),
            strftime(deal_time, '%Y-%m') AS month, strftime(list_start, '%Y-%m') AS list_month,
            {even(ratio('start_price * 10000', 'max_far * site_area'))} AS list_floor_price,
            {even(ratio('deal_price * 10000', 'max_far * site_area'))} AS deal_floor_price,
            {number('site_area')} || '㎡(' || {number(even('CAST(site_area AS DOUBLE) / 2000 * 3', 1))}
                || '亩)' AS site_area_label,
            district = '03 NATION_3' AS is_proper,
            land_use IN ('1-URGENT', '3-MEDIUM') AS is_residential,
            coalesce(land_use <> '5-LOW', TRUE) AS is_commercial
        FROM land_raw""",
    # monthly and yearly land tables
    "dealt": "SELECT *, month AS date FROM land WHERE deal_price > 0",
    "listed": "SELECT *, list_month AS date FROM land",
    "land_supply_month": f"""
        SELECT date, date AS month, count(*) AS count, sum(site_area) AS area,
            {change('sum(site_area)')} AS change FROM listed GROUP BY date""",
    "land_deal_month": f"""
        SELECT date, date AS month, count(*) AS count, sum(site_area) AS area,
            {change('sum(site_area)')} AS change FROM dealt GROUP BY date""",
    "land_ratio_month": f"""
        WITH s AS (SELECT date, sum(site_area) AS supply FROM listed GROUP BY date),
        d AS (SELECT date, sum(site_area) AS deal FROM dealt GROUP BY date)
        SELECT date, date AS month, {even(ratio('supply', 'deal'), 4)} AS supply_deal_ratio
        FROM s FULL JOIN d USING (date) WHERE date > '1997/00/01'""",
    "land_amount_month": """
        WITH v AS (SELECT date, sum(deal_price) * 10000 AS value FROM dealt GROUP BY date)
        SELECT date, date AS month, value, lag(value) OVER (ORDER BY date) AS previous,
            {change} AS change FROM v""".replace("{change}", change("value")),
    "land_floor_month": f"""
        WITH v AS (SELECT date, {floor_price()} AS value FROM dealt GROUP BY date)
        SELECT date, date AS month, value, lag(value) OVER (ORDER BY date) AS previous,
            {change('value')} AS change FROM v""",
    "land_floor_pair_month": f"""
        SELECT date AS month, {floor_price()} AS floor_price,
            {floor_price(where='is_residential')} AS res_floor_price
        FROM dealt GROUP BY date""",
    "land_floor_pair_year": f"""
        SELECT year(deal_time) AS year, {floor_price()} AS floor_price,
            {floor_price(where='is_residential')} AS res_floor_price
        FROM dealt GROUP BY year(deal_time)""",
    "land_residential_month": f"""
        WITH s AS (SELECT date, sum(site_area) AS supply FROM listed
            WHERE is_residential AND is_proper GROUP BY date),
        d AS (SELECT date, sum(site_area) AS deal FROM dealt
            WHERE is_residential AND is_proper GROUP BY date)
        SELECT date AS month, supply, deal, {even(ratio('supply', 'deal'), 4)} AS ratio
        FROM s FULL JOIN d USING (date)""",
    "land_residential_year": f"""
        WITH s AS (SELECT year(list_start) AS year, sum(site_area) AS supply FROM listed
            WHERE is_residential AND is_proper GROUP BY 1),
        d AS (SELECT year(deal_time) AS year, sum(site_area) AS deal FROM dealt
            WHERE is_residential AND is_proper GROUP BY 1)
        SELECT year, supply, deal, {even(ratio('supply', 'deal'), 4)} AS ratio
        FROM s FULL JOIN d USING (year)""",
    "land_district_amount": f"""
        WITH v AS (SELECT date, district, sum(deal_price) * 10000 AS value
            FROM dealt WHERE is_commercial GROUP BY date, district)
        SELECT date AS month, district, substring(district, 1, 2) AS short_region, value,
            lag(value) OVER (PARTITION BY district ORDER BY date) AS previous,
            {change('value', by='district')} AS change FROM v""",
    "land_district_mean": f"""
        WITH v AS (SELECT date, district, {even('avg(deal_price) * 10000', 2)} AS value
            FROM dealt WHERE is_commercial GROUP BY date, district)
        SELECT date AS month, district, substring(district, 1, 2) AS short_region, value,
            lag(value) OVER (PARTITION BY district ORDER BY date) AS previous,
            {change('value', by='district')} AS change FROM v""",
    "second_hand": """
        SELECT strftime(date_trunc('month', o_date), '%Y-%m-%d') AS date,
            strftime(o_date, '%Y-%m') AS month, n_name AS region, count(*) AS units,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 10000 AS area
        FROM orders_region GROUP BY ALL""",
    # series
    "money": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS riqi,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS m1,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)))
                FILTER (o_orderstatus <> 'P') AS DOUBLE) AS m2
        FROM orders GROUP BY 1""",
    "reserve_ratio": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
            CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS large,
            CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) / count(*) AS small_medium
        FROM orders GROUP BY 1""",
    "lending_rate": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
            CAST(count(*) FILTER (o_orderstatus = 'P') AS DOUBLE) / count(*) AS rate
        FROM orders GROUP BY 1""",
    "cpi": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)))
                FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS loan,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS m2
        FROM orders GROUP BY 1""",
    "income": """
        SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS date,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)))
                FILTER (o_orderstatus = 'F') AS DOUBLE) AS urban,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)))
                FILTER (o_orderstatus = 'O') AS DOUBLE) AS rural
        FROM orders GROUP BY 1""",
    "cpi_pair": """
        SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS riqi,
            CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS national,
            CAST(count(*) FILTER (o_orderstatus = 'P') AS DOUBLE) / count(*) AS city
        FROM orders GROUP BY 1""",
    "city_population": """
        SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS date,
            count(DISTINCT o_custkey) AS population,
            CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS urban_share,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp
        FROM orders GROUP BY 1""",
    "people": """
        SELECT CAST(date_trunc('year', o_date) AS DATE) AS date, n_name AS region,
            count(DISTINCT o_custkey) AS population,
            count(DISTINCT o_custkey) FILTER (c_mktsegment = 'BUILDING') AS urban_pop,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp
        FROM orders_region GROUP BY 1, 2""",
    "income_detail": """
        SELECT CAST(date_trunc('year', o_date) AS DATE) AS riqi, n_name AS region,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS urban
        FROM orders_region GROUP BY 1, 2""",
}


def _reads(text: str) -> set[str]:
    return {t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)}


def with_tables(body: str) -> str:
    """``body`` preceded by every logical table it reads, directly or not."""
    needed: set[str] = set()
    todo = _reads(body)
    while todo:
        needed |= todo
        todo = set().union(*(_reads(TABLES[t]) for t in todo)) - needed
    ctes = ",\n".join(f"{t} AS ({TABLES[t]})" for t in TABLES if t in needed)
    return f"WITH {ctes}\n{body}" if ctes else body
