"""The particular behaviour of single reports, on tables small enough to check by hand."""

from datetime import date
from decimal import Decimal

import pytest
from conftest import rows, values
from pyspark.sql.types import DecimalType

from estatelens import schemas
from estatelens.constants import CITY_PROPER, MISSING
from estatelens.plans import (
    deals,
    land_months,
    land_query,
    land_reports,
    macro,
    rooms,
    second_hand,
    stock,
    supply,
    views,
    volume_price,
)

YEAR = (date(2019, 1, 1), date(2019, 12, 31))


@pytest.fixture
def make(spark):
    """Rows of a declared table from keyword dictionaries; the rest is NULL."""

    def build(table, *records):
        schema = schemas.SCHEMAS[table]

        def value(record, field):
            x = record.get(field.name)
            return Decimal(x) if isinstance(field.dataType, DecimalType) and x is not None else x

        return spark.createDataFrame([tuple(value(r, f) for f in schema) for r in records], schema)

    return build


# --- land -------------------------------------------------------------------
def parcel(**values):
    base = dict(
        district=CITY_PROPER, list_start="2019-02-01", list_end="2019-03-01",
        deal_time="2019-03-05", land_use="普通商品住房用地", site_area=10_000.0, max_far=2.0,
        start_price=1_000.0, deal_price=2_000.0, gfa=20_000.0, res_area=1.0, com_area=2.0,
    )
    return base | values


def test_land_kpis(make):
    land = views.land_view(make(
        "land",
        parcel(parcel_no="a"),
        parcel(parcel_no="b", deal_price=0.0),
        parcel(parcel_no="c", deal_time=None),
        parcel(parcel_no="d", district="瑞安市"),
        parcel(parcel_no="e", site_area=None),
        parcel(parcel_no="f", deal_time="2018-12-31"),
    ))
    got = land_query.land_query_kpis(land, listed=YEAR, dealt=YEAR)
    # a, b and e; the area of e counts as zero, its price counts in the sum
    assert rows(got) == [(3, 2.0, 750.0, 2, 1.0, 2000.0)]
    got = land_query.land_query_kpis(land, listed=YEAR, dealt=YEAR, min_area="1")
    assert rows(got) == [(2, 2.0, 500.0, 1, 1.0, 1000.0)]


def test_land_kpis_of_nothing(make):
    land = views.land_view(make("land", parcel()))
    got = land_query.land_query_kpis(land, listed=YEAR, dealt=YEAR, parcel_nos=["none"])
    assert rows(got) == [(0, 0.0, None, 0, 0.0, None)]


def test_land_query_default_period_is_a_year_until_yesterday(make):
    land = views.land_view(make("land", *(
        parcel(parcel_no=day, list_start=day, deal_time=day)
        for day in ("2018-06-14", "2018-06-15", "2019-06-14", "2019-06-15")
    )))
    got = land_query.land_query_table(land, as_of=date(2019, 6, 15))
    assert sorted(values(got.select("parcel_no"))) == ["2018-06-15", "2019-06-14"]


def test_land_view(make):
    land = views.land_view(make(
        "land",
        parcel(site_area=66_666.0, detail_url="javascript:goRes('13752','01');", location="x"),
        parcel(site_area=None, land_use=None, list_start="2019/2/1"),
    ))
    got = land.select(
        "month", "list_month", "list_start", "list_floor_price", "site_area", "site_area_label",
        "location", "is_residential", "is_commercial", "is_proper",
    )
    assert rows(got) == [
        ("2019-03", "2019-02", date(2019, 2, 1), 75.0, 66_666.0, "66666㎡(100亩)",
         "瓯海区娄桥街道杆南村", True, True, True),
        ("2019-03", "2019/2/", date(2019, 2, 1), None, 0.0, None, None, None, True, True),
    ]


def test_commercial_keeps_unknown_uses(make):
    land = views.land_view(make(
        "land", parcel(land_use=None), parcel(land_use="教育用地"), parcel(land_use="旅馆用地"),
        parcel(land_use="养老服务用地"),
    ))
    months = ("2019-01", "2019-12")
    assert values(land_reports.land_structure_commercial(land, months).select("site_area")) == [
        20_000.0
    ]
    assert values(land_reports.land_structure_residential(land, months).select("site_area")) == [
        20_000.0
    ]


def test_floor_price_sides_skip_missing_values_on_their_own(make):
    land = views.land_view(make("land", parcel(), parcel(max_far=None)))
    got = land_reports.land_structure_residential(land, ("2019-03", "2019-03"))
    assert rows(got) == [("2019-03", 20_000.0, 40_000.0, 2000.0)]


def test_open_listings(make):
    land = views.land_view(make(
        "land",
        parcel(parcel_no="open", deal_price=0.0),
        parcel(parcel_no="newer", deal_price=0.0, list_start="2019-02-20"),
        parcel(parcel_no="sold"),
        parcel(parcel_no="no price", deal_price=None),
        parcel(parcel_no="long ago", deal_price=0.0, list_end="2019-02-28"),
    ))
    got = land_reports.land_open_listings(land, as_of=date(2019, 3, 16))
    assert values(got.select("parcel_no")) == ["newer", "open"]


def test_mean_price_is_per_parcel_and_shares_add_up(make):
    land = views.land_view(make(
        "land", parcel(deal_price=1.0, site_area=1.0), parcel(deal_price=2.0, site_area=99.0),
        parcel(deal_price=4.5, district="瑞安市"),
    ))
    got = rows(land_reports.land_district_mean_price(land, "2019-03"))
    assert got == [("瑞安市", 4.5, 0.75), (CITY_PROPER, 1.5, 0.25)]


def test_month_kpis(make):
    report = views.land_month_view(make(
        "land_supply_month", dict(date="2019/02/01", count=3, area=123_456.0, change=0.12345),
        dict(date="2019/03/01", count=4, area=1.0, change=None),
    ))
    assert rows(land_reports.month_kpis(report, "2019-02")) == [("2019-02", 3, 12.35, 12.3)]


def test_rebuilt_changes_are_per_district(make):
    land = views.land_view(make(
        "land",
        parcel(deal_time="2019-01-05", deal_price=1.0), parcel(deal_time="2019-03-05", deal_price=3.0),
        parcel(deal_time="2019-02-05", deal_price=9.0, district="瑞安市"),
    ))
    got = land_months.land_district_amount(land).orderBy("date")
    assert rows(got.select("date", "value", "previous", "change")) == [
        ("2019-01", 10_000.0, None, None), ("2019-02", 90_000.0, None, None),
        ("2019-03", 30_000.0, 10_000.0, 2.0),
    ]


def test_rebuilt_ratio_keeps_months_of_one_side(make):
    land = views.land_view(make(
        "land", parcel(), parcel(list_start="2019-03-01", deal_price=0.0, site_area=5_000.0)
    ))
    got = land_months.land_residential_month(land).orderBy("date")
    assert rows(got) == [
        ("2019-02", 10_000.0, None, None), ("2019-03", 5_000.0, 10_000.0, 0.5)
    ]


# --- homes ------------------------------------------------------------------
def deal(**values):
    return dict(region="鹿城区", category="住宅", date=date(2019, 5, 1), units=1, area=100,
                res_price=20_000, record_name="a", promo_name="p", band="b") | values


def deal_frame(spark, *records):
    frame = spark.createDataFrame(
        [tuple(r.get(n) for n in ("region", "category", "date", "units", "area", "res_price",
                                  "record_name", "promo_name", "band")) for r in records],
        "region string, category string, date date, units int, area int, res_price int, "
        "record_name string, promo_name string, band string",
    )
    return views.deal_view(frame)


def test_deal_bounds_are_not_the_same_for_all_figures(spark):
    frame = deal_frame(
        spark, deal(area=100, units=1), deal(area=30_000, units=200, res_price=0),
        deal(area=60_000, units=1), deal(area=10_000, units=0), deal(category="商业"),
    )
    choices = dict(regions=["鹿城区"], category="住宅", period=YEAR)
    got = deals.deal_kpis(frame, **choices, min_area="100")
    assert rows(got) == [(201, 3.0, None)]
    got = deals.deal_kpis(frame, **choices)
    assert rows(got) == [(201, 3.01, 2.0)]


def test_deal_units_are_missing_if_one_is(spark):
    frame = deal_frame(spark, deal(), deal(band="c"), deal(band="c", units=None))
    got = volume_price.units_by_band(frame, period=YEAR)
    assert rows(got) == [("b", 1, 1.0), ("c", None, None)]


def test_deal_table_labels_missing_prices(spark):
    frame = deal_frame(
        spark, deal(units=2), deal(units=1, res_price=20_003), deal(record_name="z", res_price=None),
        deal(record_name="n", promo_name=None, units=9, area=999, res_price=None),
    )
    got = deals.deal_table(frame, regions=["鹿城区"], category="住宅", period=YEAR)
    assert rows(got) == [
        (MISSING, "n", "鹿城区", 9, 999, MISSING), ("p", "a", "鹿城区", 3, 200, "20002"),
        ("p", "z", "鹿城区", 1, 100, MISSING),
    ]


def test_prices_per_year(spark):
    frame = deal_frame(
        spark, deal(date=date(2017, 1, 1), res_price=10), deal(date=date(2019, 1, 1), res_price=20),
        deal(date=date(2019, 1, 1), res_price=30, area=300), deal(res_price=None), deal(res_price=0),
    )
    assert rows(volume_price.price_yearly(frame, regions=["鹿城区"])) == [
        (2017, 1, 10.0), (2019, 2, 27.5)
    ]
    assert rows(volume_price.price_yearly_change(frame, regions=["鹿城区"])) == [
        (2017, 10.0, None), (2019, 27.5, 1.75)
    ]


def project(**values):
    return dict(region="鹿城区", open_date=date(2019, 5, 1), record_name="a", area=10_000,
                total_units=100, for_sale=50, non_sale=0, res_price=0, com_price=5) | values


def test_supply_area_is_rounded_per_row_in_one_place_and_at_the_end_in_the_other(make):
    frame = views.supply_view(make("history_supply", *(
        project(record_name=str(i), area=20_000, total_units=100, for_sale=3) for i in range(10)
    )))
    choices = dict(regions=["鹿城区"], period=YEAR)
    # 0.06 each
    assert rows(supply.supply_kpis(frame, **choices)) == [(1000, 30, pytest.approx(0.6))]
    frame = views.supply_view(make("history_supply", *(
        project(record_name=str(i), area=20_000, total_units=100, for_sale=2, res_price=None)
        for i in range(9)
    ), project(area=333, total_units=3, for_sale=1)))
    got = supply.supply_kpis(frame, **choices)
    assert rows(got) == [(903, 19, pytest.approx(9 * 0.04 + 0.01))]


def test_supply_and_sale_figures(spark, make):
    frame = views.supply_view(make(
        "history_supply", project(), project(record_name="b", area=6_000_000, for_sale=10),
        project(record_name="c", total_units=0), project(record_name="d", non_sale=None),
    ))
    sold = deal_frame(spark, deal(units=3, area=12_345))
    got = supply.supply_sale_kpis(frame, sold, regions=["鹿城区"], period=YEAR)
    # b is above the upper bound, which the area for sale does not have
    assert rows(got) == [(None, 100, 61.0, 3, 1.2)]


def test_supply_table(make):
    frame = views.supply_view(make(
        "history_supply", project(), project(record_name="none left", for_sale=0),
        project(record_name="b", for_sale=80, promo_name="x", res_price=123),
    ))
    got = supply.supply_table(frame, regions=["鹿城区"], period=YEAR)
    assert rows(got) == [
        ("x", "b", "鹿城区", 100, 80, 8000.0, "20%", "123", "5"),
        (MISSING, "a", "鹿城区", 100, 50, 5000.0, "50%", MISSING, "5"),
    ]


def test_rooms(make):
    room = dict(promo_name="p", record_name="r", building="1", room_no="101", status="已售",
                area=80.0, unit_price=10.0)
    frame = views.room_view(make(
        "room", room, room | dict(status="可售", room_no="102"), room | dict(area=None),
        room | dict(status=None, record_name=None, area=60_000.0),
        room | dict(promo_name="q", status="安置房", area=20_000.0),
    ))
    assert rows(rooms.room_kpis(frame, promo_names=["p"])) == [(3, 2, 0.01)]
    assert rows(rooms.room_kpis(frame)) == [(4, 3, 2.01)]
    got = rooms.room_table(frame, promo_names=["p"], max_area="99999", statuses=[MISSING])
    assert rows(got) == [("p", MISSING, None, "1", "101", MISSING, 60_000.0, 10.0, 600_000.0)]
    labels = frame.where("area = 0").select("total_price", "total_price_label")
    assert rows(labels) == [(None, MISSING)]


# --- stock ------------------------------------------------------------------
def test_stock_and_ratios(make):
    frame = views.stock_view(make(
        "region_band_stock",
        dict(date=date(2018, 1, 1), region="鹿城区", band="b", units=None, area_y=1_000,
             total_units=100, non_sale=10, for_sale=1, area=1),
        dict(date=date(2019, 1, 1), region="鹿城区", band="b", units=30),
        dict(date=date(2019, 1, 2), region="龙湾区", band="c", units=5, total_units=7,
             non_sale=None, area_y=None),
    ))
    got = stock.stock_kpis(frame, regions=["鹿城区"], bands=["b"], cutoff=date(2019, 1, 1))
    assert rows(got) == [(60, 0.1)]
    assert rows(stock.stock_by_region(frame, 2018)) == [("鹿城", 90)]
    assert rows(stock.stock_by_region(frame, 2019)) == [("鹿城", 60), ("龙湾", -5)]
    assert rows(stock.ratio_by_region(frame, period=YEAR)) == [("鹿城", 0.0), ("龙湾", 0.0)]
    assert rows(stock.stock_by_band(frame, 2018)) == [("b", 90, 1.0)]


def test_sell_through_subtracts_after_summing(make):
    frame = views.region_ratio_view(make(
        "region_ratio",
        dict(date=date(2019, 1, 1), region="鹿城区", units=4, total_units=10, non_sale=None),
        dict(date=date(2019, 1, 31), region="鹿城区", units=None, total_units=None, non_sale=2),
        dict(date=date(2019, 2, 1), region="鹿城区", units=99, total_units=1, non_sale=0),
    ))
    assert rows(volume_price.sell_through_by_region(frame, date(2019, 2, 10))) == [("鹿城", 0.5)]


def test_new_openings(make):
    frame = views.project_view(make(
        "project_name", dict(record_name="a", open_date=date(2019, 2, 1), units=1, area=2.0),
        dict(record_name="b", open_date=date(2019, 1, 31)),
        dict(record_name="c", promo_name="x", open_date=date(2019, 2, 5)),
    ))
    got = volume_price.new_openings(frame, date(2019, 2, 10))
    assert rows(got) == [
        ("c", "x", None, date(2019, 2, 5), None, None),
        ("a", MISSING, None, date(2019, 2, 1), 1, 2.0),
    ]


# --- second-hand and macro --------------------------------------------------
def test_second_hand(make):
    frame = views.second_hand_view(make(
        "second_hand", dict(date="2019-01-01", region="a", units=2, area=0.5),
        dict(date="2019-01-15", region="a", units=None, area=1.0),
        dict(date="2019-02-01", region="b", units=3, area=None),
    ))
    assert rows(second_hand.second_hand_by_region(frame, "2019-01", ["a", "b"])) == [
        ("a", 2, 15_000.0)
    ]
    assert rows(second_hand.second_hand_units_wide(frame, ["a", "b"])) == [
        ("2019-01", 2, None), ("2019-02", None, 3)
    ]
    assert rows(second_hand.second_hand_area_series(frame, ["b"])) == [
        ("b", "2019-02-01", "2019-02", None)
    ]


def test_money(make):
    months = [date(2017 + i // 12, i % 12 + 1, 1) for i in range(26)]
    frame = make("money", *(dict(riqi=d, m1=100.0 + i, m2=200.0) for i, d in enumerate(months)))
    got = rows(macro.money_yoy(frame))
    assert [r[1] for r in got] == [f"2018-{m:02d}" for m in range(5, 13)] + ["2019-01", "2019-02"]
    assert got[-1] == (date(2019, 2, 1), "2019-02", 125.0, 200.0, round(125 / 113 - 1, 4), 0.0)
    assert rows(macro.money_yoy(frame, calendar=True)) == got
    assert rows(macro.money_latest(frame)) == [(0.0125, 0.02)]


def test_people(make):
    frame = make("people", *(
        dict(date=date(y, 12, 31), region=r, population=p, urban_pop=p / 3, gdp=p * 2)
        for y, r, p in [
            (2016, "鹿城区", 100.0), (2017, "鹿城区", 110.0), (2017, "龙湾区", 90.0),
            (2017, "全市", 500.0), (2018, "市区", 200.0), (2017, None, 10.0),
        ]
    ))
    # the newest year is looked up in the whole table, totals included
    assert rows(macro.population_by_region(frame)) == []
    got = macro.population_by_region(frame.where("date < '2018-01-01'"))
    assert rows(got) == [("鹿城", 110.0, 110 / 210), ("龙湾", 90.0, 90 / 210), (None, 10.0, 10 / 210)]
    assert rows(macro.population_growth(frame, "鹿城区")) == [
        ("鹿城区", 2016, 100.0, None), ("鹿城区", 2017, 110.0, 0.1)
    ]
    assert rows(macro.urban_share(frame, "龙湾区")) == [("龙湾区", 33.0)]
    assert values(macro.gdp_series(frame, "鹿城区").select("gdp")) == [200.0, 220.0]


def test_city(make):
    frame = make("city_population", dict(
        date=date(2017, 1, 1), population=921.5, urban_share=0.697, gdp=5453.2))
    assert rows(macro.city_population_kpis(frame)) == [(921.5, pytest.approx(69.7))]
    assert rows(macro.gdp_kpis(frame)) == [(5453.2, 59177.0)]
    assert rows(macro.gdp_kpis(frame, 2018)) == []


def test_series_filters(make):
    frame = make("reserve_ratio", dict(date=date(2014, 1, 1), large=0.2, small_medium=0.1),
                 dict(date=date(2016, 1, 1), large=0.17, small_medium=0.15),
                 dict(date=date(2015, 1, 1), large=0.18, small_medium=0.16))
    assert values(macro.reserve_series(frame)) == [date(2015, 1, 1), date(2016, 1, 1)]
    assert rows(macro.reserve_latest(frame)) == [(pytest.approx(17.0), pytest.approx(15.0))]
    assert rows(macro.lending_latest(make("lending_rate"))) == []
