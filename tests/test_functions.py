from datetime import date
from decimal import Decimal

import pytest
from conftest import rows, values
from pyspark.sql import functions as F

from estatelens import functions as fx
from estatelens.constants import MISSING
from estatelens.functions.text import number_text, percent_text, price_label


@pytest.mark.parametrize("area, units, band", [
    (89.99, 1, "小于90㎡面积"),
    (90.0, 1, "90-120㎡面积"),
    (120.0, 1, "90-120㎡面积"),
    (120.01, 1, "120-144㎡面积"),
    (144.0, 1, "120-144㎡面积"),
    (144.01, 1, "144-180㎡面积"),
    (180.0, 1, "144-180㎡面积"),
    (180.01, 1, "180㎡以上面积"),
    (100.0, 0, "180㎡以上面积"),
    (0.0, 0, None),
    (None, 3, None),
    (100.0, None, None),
])
def test_area_band(table, area, units, band):
    df = table("area double, units int", (area, units))
    assert values(df.select(fx.area_band("area", "units"))) == [band]


def test_finite(table):
    df = table("x double", (1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,))
    assert values(df.select(fx.finite("x"))) == [1.5, None, None, None, None]


def test_ratio_by_zero_is_missing(table):
    df = table("a double, b double", (1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, 2.0))
    assert values(df.select(fx.ratio("a", "b"))) == [None, None, None, 1.5]


@pytest.mark.parametrize("x, digits, expected", [
    (0.125, 2, 0.12), (0.375, 2, 0.38), (2.5, 0, 2.0), (3.5, 0, 4.0), (-0.3, 0, 0.0),
    (1234.5678, 1, 1234.6),
])
def test_round_even(table, x, digits, expected):
    df = table("x double", (x,))
    result = values(df.select(fx.round_even("x", digits)))[0]
    assert result == expected and str(result) == str(expected)


def test_round_even_is_array_rounding(spark):
    import numpy as np

    x = np.round(np.random.default_rng(1).uniform(-1000, 1000, 2000), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert values(df.select(fx.round_even("x", 2))) == [float(v) for v in np.round(x, 2)]


@pytest.mark.parametrize("text, expected", [
    ("2019-03-04", date(2019, 3, 4)),
    ("2019-3-4", date(2019, 3, 4)),
    ("2019/3/4", date(2019, 3, 4)),
    ("20190304", date(2019, 3, 4)),
    ("2019-02-30", None),
    ("2019-03", None),
    ("2019", None),
    ("201903", None),
    ("2019-03-04 10:00:00", None),
    ("x", None), ("", None), (None, None),
])
def test_parse_date(table, text, expected):
    assert values(table("t string", (text,)).select(fx.parse_date("t"))) == [expected]


def test_as_date_leaves_dates_bare(table):
    df = table("d date, t string", (date(2019, 3, 4), "2019/3/5"))
    assert fx.as_date(df, "d")._jc.toString() == F.col("d")._jc.toString()
    assert rows(df.select(fx.as_date(df, "d"), fx.as_date(df, "t"))) == [
        (date(2019, 3, 4), date(2019, 3, 5))
    ]


def test_month_and_year_keys(table):
    df = table("d date, t string", (date(2019, 3, 4), "2019/3/4"))
    assert rows(df.select(
        fx.month_key("d"), fx.month_key("t"), fx.year_key("d"), fx.slash_to_dash("t")
    )) == [("2019-03", "2019/3/", "2019", "2019-3-4")]


def test_relative_dates(table):
    df = table("x int", (1,))
    day = date(2019, 3, 15)
    assert rows(df.select(fx.first_of_month(day), fx.last_of_previous_month(day))) == [
        (date(2019, 3, 1), date(2019, 2, 28))
    ]
    assert fx.last_days(30, day) == (date(2019, 2, 13), date(2019, 3, 14))


def test_to_number(table):
    df = table("t string", ("1.5",), ("x",), ("",), (None,))
    assert values(df.select(fx.to_number("t"))) == [1.5, None, None, None]


def test_sums(table):
    df = table("k string, x double", ("a", 1.0), ("a", None), ("b", None), ("c", 2.0))
    got = df.groupBy("k").agg(fx.sum0("x"), fx.sum_strict("x")).orderBy("k")
    assert rows(got) == [("a", 1.0, None), ("b", 0.0, None), ("c", 2.0, 2.0)]
    assert rows(df.where("k = 'z'").agg(fx.sum0("x"), fx.sum_strict("x"))) == [(0.0, 0.0)]


def test_conditional_sums(table):
    df = table("x double, ok boolean", (1.0, True), (None, False), (2.0, None), (4.0, True))
    ok = F.col("ok")
    assert rows(df.agg(fx.sum0("x", ok), fx.sum_strict("x", ok), fx.count_rows(ok))) == [
        (5.0, 5.0, 2)
    ]
    df = df.withColumn("ok", F.lit(True))
    assert values(df.agg(fx.sum_strict("x", F.col("ok")))) == [None]


def test_ratio_of_sums_skips_each_side_on_its_own(table):
    df = table("a double, b double", (10.0, None), (None, 4.0), (2.0, 2.0))
    assert values(df.agg(fx.ratio_of_sums("a", "b", 10))) == [20.0]


def test_weighted_mean_keeps_weights_of_missing_values(table):
    df = table("price double, area double", (10.0, 1.0), (None, 3.0), (20.0, 1.0))
    assert values(df.agg(fx.weighted_mean("price", "area"))) == [6.0]
    assert values(df.agg(fx.weighted_mean("price", "area", fx.positive("price")))) == [15.0]


def test_decimal_sums_stay_exact(spark):
    df = spark.range(3).select(F.lit(Decimal("0.10")).cast("decimal(10,2)").alias("x"))
    assert values(df.agg(fx.sum0("x"))) == [Decimal("0.30")]


def test_not_member_keeps_missing(table):
    df = table("use string", ("a",), ("b",), (None,))
    assert values(df.where(fx.not_member("use", ["a"]))) == ["b", None]
    assert values(df.where(fx.member("use", ["a"]))) == ["a"]
    assert values(df.where(fx.member("use", "b"))) == ["b"]
    assert values(df.where(fx.member("use", []))) == []


def test_choice(table):
    df = table("use string", ("a",), ("b",), (None,))
    assert values(df.where(fx.choice("use", None))) == ["a", "b", None]
    assert values(df.where(fx.choice("use", []))) == ["a", "b", None]
    assert values(df.where(fx.choice("use", ["a"]))) == ["a"]


def test_negated_positive_drops_missing(table):
    df = table("price double", (None,), (0.0,), (5.0,))
    assert values(df.where(~fx.positive("price"))) == [0.0]


@pytest.mark.parametrize("low, inclusive, kept", [
    ("10", True, [10.0, 11.0]), ("10", False, [11.0]), (10, True, [10.0, 11.0]),
    ("", True, [0.0, 10.0, 11.0]), (None, False, [10.0, 11.0]), ("ten", True, []),
])
def test_within(table, low, inclusive, kept):
    df = table("x double", (0.0,), (10.0,), (11.0,), (99.0,), (None,))
    assert values(df.where(fx.within("x", low, "", (0, 50), inclusive=inclusive))) == kept


def test_range_ends_are_inside(table):
    df = table("m string", ("2018-12",), ("2019-01",), ("2019-03",), ("2019-04",), (None,))
    assert values(df.where(fx.between("m", ("2019-01", "2019-03")))) == ["2019-01", "2019-03"]


def test_labels(table):
    df = table("x double, s string", (1200.50, "鹿城区"), (0.0, None))
    assert rows(df.select(
        number_text("x"), price_label("x"), fx.or_missing("s"), fx.short_name("s"),
        fx.with_unit("x", "套"),
    )) == [("1200.5", "1200.5", "鹿城区", "鹿城", "1200.5套"), ("0", MISSING, MISSING, None, "0套")]


def test_percent_text(table):
    df = table("x double", (0.57,), (1.0,), (None,))
    assert values(df.select(percent_text("x"))) == ["57%", "100%", None]


def test_strip_text(table):
    df = table("s string", ("某项目（详细信息）",), (None,))
    assert values(df.select(fx.strip_text("s", "（详细信息）"))) == ["某项目", None]
