from datetime import date

from conftest import executed_plan, planned, rows, values
from pyspark.sql import functions as F

from estatelens import operators as op
from estatelens.constants import OTHER, RESIDENTIAL, ROOM_CATEGORY, SALE_CATEGORY
from estatelens.plans import macro


def test_category_defaults_differ(table):
    df = table("raw string", ("别墅",), ("商铺",), ("车位",), ("新类",), (None,))
    assert values(df.select(op.category("raw", SALE_CATEGORY, OTHER))) == [
        "住宅", "商业", "其他", "其他", "其他"
    ]
    assert values(df.select(op.category("raw", ROOM_CATEGORY, RESIDENTIAL))) == [
        "住宅", "商业", "其他", "住宅", "住宅"
    ]


def test_categories_do_not_overlap():
    for groups in (SALE_CATEGORY, ROOM_CATEGORY):
        names = [n for members in groups.values() for n in members]
        assert len(names) == len(set(names))


def test_category_from_a_table(table):
    df = table("id int, raw string", (1, "a"), (2, "b"), (3, None))
    mapping = table("raw string, category string", ("a", "A"))
    got = op.with_category(df, "raw", mapping, "none").orderBy("id")
    assert rows(got) == [(1, "a", "A"), (2, "b", "none"), (3, None, "none")]


def test_keep_last(table):
    df = table(
        "k string, n string, v int, pos int",
        ("a", "x", 1, 1), ("a", "x", 2, 2), ("a", None, 3, 1), (None, None, 4, 1),
        (None, None, 5, None), ("b", "x", 6, None),
    )
    got = op.keep_last(df, ["k", "n"], ["pos"])
    assert sorted(values(got.select("v"))) == [2, 3, 4, 6]
    assert got.columns == df.columns


def test_keep_last_limits_rows_before_the_shuffle(spark):
    df = spark.range(0, 1000, 1, 8).select((F.col("id") % 3).alias("k"), "id")
    plan = planned(op.keep_last(df, ["k"], ["id"]))
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_latest_row(table):
    df = table("d date, v int", (date(2019, 1, 1), 1), (date(2019, 2, 1), 2), (None, 3))
    assert rows(op.latest_row(df, "d")) == [(date(2019, 2, 1), 2)]
    assert rows(op.latest_row(df.where("v > 9"), "d")) == []


def test_lookup_matches_missing_keys_and_fans_out(table):
    left = table("id int, k string", (1, "a"), (2, None), (3, "z"))
    right = table("k string, name string", ("a", "p"), ("a", "q"), (None, "none"))
    got = op.lookup(left, right, {"k": "k"}).orderBy("id", "name")
    assert got.columns == ["id", "k", "name"]
    assert rows(got) == [(1, "a", "p"), (1, "a", "q"), (2, None, "none"), (3, "z", None)]


def test_lookup_splits_a_hot_key(spark, conf):
    """A third of the rows on one key, no broadcast: the join is split."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    n = 90_000
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    left = spark.range(0, n, 1, 8).select(key.alias("k"), F.col("id").alias("v"))
    prices = left.groupBy("k").agg(F.count(F.lit(1)).alias("price"))
    joined = op.lookup(left, prices, {"k": "k"})
    assert "skew=true" in executed_plan(joined)
    assert joined.count() == n
    assert joined.where("k = 'hot'").agg(F.min("price"), F.max("price")).first() == (n // 3, n // 3)


def test_outer_on_keys(table):
    left = table("d int, r string, x int", (1, "a", 10), (2, "a", 20))
    right = table("d int, r string, y int", (2, "a", 5), (3, "b", 6))
    got = op.outer_on_keys(left, right, ["d", "r"]).orderBy("d")
    assert rows(got) == [(1, "a", 10, None), (2, "a", 20, 5), (3, "b", None, 6)]


def test_side_by_side(table):
    got = op.side_by_side(table("a int, b int", (1, None)), table("c string", ("x",)))
    assert got.columns == ["a", "b", "c"] and rows(got) == [(1, None, "x")]


def test_rollup_drops_missing_keys_and_sums_to_zero(table):
    df = table("k string, x int", ("a", None), ("b", 1), ("b", 2), (None, 9))
    got = op.rollup_present_keys(df, ["k"], ["x"]).orderBy("k")
    assert rows(got) == [("a", 0), ("b", 3)]


def test_change_from_previous(table):
    df = table("y int, r string, p double", (2017, "a", 10.0), (2019, "a", 15.0), (2018, "b", 7.0))
    got = op.change_from_previous(df, "p", "y", by=["r"], previous="before").orderBy("r", "y")
    assert rows(got) == [
        (2017, "a", 10.0, None, None), (2019, "a", 15.0, 10.0, 0.5), (2018, "b", 7.0, None, None)
    ]


def test_change_on_one_row_and_from_zero(table):
    one = table("y int, p double", (2017, 1.0))
    assert rows(op.change_from_previous(one, "p", "y")) == [(2017, 1.0, None)]
    zero = table("y int, p double", (2017, 0.0), (2018, 1.0))
    assert values(op.change_from_previous(zero, "p", "y").orderBy("y").select("change")) == [
        None, None
    ]


def test_twelve_rows_are_rows_and_months_are_months(spark):
    """Thirteen rows with a month missing in between."""
    months = [date(2018, m, 1) for m in range(1, 13) if m != 5]
    months += [date(2019, 1, 1), date(2019, 2, 1)]
    df = spark.createDataFrame([(d, float(i + 1)) for i, d in enumerate(months)], "d date, v double")
    by_row = {r.d: r.change for r in op.change_from_previous(df, "v", "d", rows=12).collect()}
    assert by_row[date(2019, 2, 1)] == 12.0 and by_row[date(2019, 1, 1)] is None
    by_month = {r.d: r.change for r in op.change_by_calendar(df, "v", "d").collect()}
    assert by_month[date(2019, 1, 1)] == 11.0 and by_month[date(2019, 2, 1)] == 5.5
    assert by_month[date(2018, 6, 1)] is None and len(by_month) == len(months)


def test_calendar_change_of_a_missing_region(table):
    df = table(
        "r string, d date, v double", (None, date(2018, 1, 1), 1.0), (None, date(2019, 1, 1), 3.0)
    )
    got = op.change_by_calendar(df, "v", "d", by=["r"]).orderBy("d")
    assert values(got.select("change")) == [None, 2.0]


def test_share(table):
    df = table("k string, v double", ("a", 1.0), ("b", 3.0))
    assert rows(op.with_share(df, "v").orderBy("k")) == [("a", 1.0, 0.25), ("b", 3.0, 0.75)]


def test_sorting_puts_missing_last(table):
    df = table("x int", (2,), (None,), (1,))
    assert values(op.ascending(df, "x")) == [1, 2, None]
    assert values(op.descending(df, "x")) == [2, 1, None]


def test_newest_then_ascending(table):
    df = table("x int", *((i,) for i in (3, 1, 2, 5, 4)))
    assert values(op.newest_then_ascending(df, "x", 3)) == [3, 4, 5]


def test_domains(table):
    df = table("m string", ("",), ("2019-02",), ("2019-01",), ("2019-02",), (None,))
    assert set(values(op.distinct_values(df, "m"))) == {"", "2019-01", "2019-02", None}
    assert values(op.sorted_values(df, "m", drop_smallest=True)) == ["2019-01", "2019-02"]
    assert values(op.sorted_values(df, "m", newest_first=True)) == ["2019-02", "2019-01", ""]
    assert values(op.newest_value(df, "m")) == ["2019-02"]


def test_pivot(table):
    df = table("m string, r string, v int", ("1", "a", 1), ("1", "b", 2), ("2", "a", 3))
    got = op.pivot_series(df, "m", "r", ["a", "b"], F.sum("v")).orderBy("m")
    assert rows(got) == [("1", 1, 2), ("2", 3, None)]


def test_rows_that_are_equal_in_all_columns_spread_over_ranges(spark, conf):
    """Half the rows are the same: no range gets more than twice the median."""
    conf(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="8")
    n = 40_000
    half = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id"))
    df = spark.range(0, n, 1, 8).select(half.alias("a"), F.lit("x").alias("b"))

    def sizes(sorted_rows):
        counts = sorted_rows.groupBy(F.spark_partition_id().alias("p")).count()
        return sorted(values(counts.select("count")))

    order = [F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last()]
    plain, spread = sizes(df.orderBy(*order)), sizes(op.spread(df, *order))
    assert plain[-1] > 2 * plain[len(plain) // 2] and spread[-1] < 2 * spread[len(spread) // 2]
    got = op.spread(df, *order)
    assert got.columns == ["a", "b"]
    assert values(got.select("a")) == sorted([7] * (n // 2) + list(range(1, n, 2)))


def test_only_counted_tables_are_broadcast(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    small = spark.range(10).withColumnRenamed("id", "k")
    for rows, kind in ((10, "BroadcastHashJoin"), (9, "SortMergeJoin")):
        joined = op.lookup(spark.range(20), op.broadcast_if_small(small, rows), {"id": "k"})
        assert kind in planned(joined) and joined.count() == 20


def test_latest_year_reads_its_table_once(spark, tmp_path):
    rows_ = [(f"{y}-0{m}-01", y * 10 + m) for y in (2017, 2019, 2018) for m in (1, 2)] + [(None, 0)]
    spark.createDataFrame(rows_, "d string, v int").selectExpr("to_date(d) AS date", "v").repartition(3).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    newest = macro.latest_year(stored)
    assert sorted(values(newest.select("v"))) == [20191, 20192]
    plan = planned(newest)
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan and "Subquery" not in plan
    assert macro.latest_year(stored.where("date is null")).count() == 0
    people = stored.select("date", F.col("v").cast("string").alias("region"), F.col("v").alias("population"))
    assert planned(macro.population_by_region(people)).count("FileScan") == 1
