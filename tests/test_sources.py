from datetime import date, datetime
from decimal import Decimal
from functools import partial
from pathlib import Path

import pytest
from conftest import planned, rows, values
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens import schemas
from estatelens.plans import catalog, deals, pickers, views
from estatelens.sources import sinks, versions
from estatelens.sources.splitting import literal
from estatelens.sources import (
    Partitioning,
    WorkingTables,
    conform,
    drop_non_finite,
    jdbc_options,
    jdbc_write_options,
    normalise_names,
    quantiles,
    range_predicates,
    read_jdbc,
    read_parquet,
    register_views,
    typed,
    with_headings,
    with_units,
    write_table,
)


def test_source_names_cover_the_schemas():
    for table, schema in schemas.SCHEMAS.items():
        source, renames = schemas.SOURCE_TABLES[table]
        assert source and set(renames.values()) <= set(schema.fieldNames()), table


def test_names_are_recognised_as_they_are_and_in_syntactic_form(table):
    names = ["预售许可证号", "项目名称", "住宅均价(元/㎡)", "商业均价.元..."]
    df = table(", ".join(f"`{n}` string" for n in names), ("a", "b", "c", "d"))
    assert normalise_names(df, "history_supply").columns == [
        "permit", "record_name", "res_price", "com_price"
    ]


def test_other_names_stay(table):
    df = table("riqi date, `M1数量.亿元.` double, note string", (None, 1.0, "x"))
    assert normalise_names(df, "money").columns == ["riqi", "m1", "note"]


def test_drop_non_finite(table):
    df = table("x double, y float, z int", (float("nan"), float("inf"), 1))
    assert rows(drop_non_finite(df)) == [(None, None, 1)]


def test_conform_casts_text_and_keeps_matching_columns(table):
    df = table("date string, region string, units string, area double",
               ("2019/3/4", "r", "x", float("inf")))
    got = conform(df, "second_hand")
    assert got.schema == schemas.SECOND_HAND
    assert rows(got) == [("2019/3/4", "r", None, None)]


def test_read_parquet_pushes_filters_and_prunes_columns(spark, tmp_path):
    source = spark.createDataFrame(
        [("r", "p", "n", "住宅", 1, Decimal("90.00"), date(2019, 1, 1))], schemas.SALE_DAILY
    )
    names = {v: k for k, v in schemas.SOURCE_TABLES["sale_daily"][1].items()}
    source.withColumnsRenamed(names).write.parquet(str(tmp_path / "sale_daily"))
    df = read_parquet(spark, str(tmp_path), "sale_daily")
    assert df.columns == schemas.SALE_DAILY.fieldNames()
    plan = planned(df.where("region = 'r'").groupBy("date").agg(F.sum("units")))
    assert "EqualTo(`所在地区`,r)" in plan
    assert "ReadSchema: struct<所在地区:string,套数:bigint,日期:date>" in plan


def test_jdbc_options():
    options = jdbc_options(
        "jdbc:mysql://host/db", "t", Partitioning("id", 0, 1000, 20), {"user": "u"}
    )
    assert options == {
        "url": "jdbc:mysql://host/db", "dbtable": "t", "fetchsize": "10000", "user": "u",
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "1000", "numPartitions": "20",
    }
    assert "numPartitions" not in jdbc_options("jdbc:x", "t", None, {})


def test_jdbc_write_options(spark):
    options = jdbc_write_options("jdbc:mysql://host/db", "region_band_stock", 8, {"user": "u"})
    assert options["dbtable"] == "各区域库存_python" and options["numPartitions"] == "8"
    assert options["createTableColumnTypes"] == (
        "`日期` DATE, `所在地区` VARCHAR(255), `面积段` VARCHAR(255), `套数` INTEGER, "
        "`建筑面积_x` DECIMAL(10,2), `待售房源` INTEGER, `建筑面积_y` DECIMAL(10,2), "
        "`房源总量` INTEGER, `非销售房产` INTEGER, `项目测算面积` DECIMAL(10,2)"
    )
    types = jdbc_write_options("x", "deal_list", 1, {})["createTableColumnTypes"]
    assert len(T.StructType.fromDDL(types)) == len(schemas.DEAL_LIST)  # Spark can read it


def test_typed_rounds_counts_and_orders_columns(table):
    df = table("units double, region string, date date, total_units double, for_sale double, "
               "non_sale double", (2.9999999, "r", date(2019, 1, 1), 1.0, None, 0.0))
    got = typed(df, "region_ratio")
    assert got.columns == schemas.REGION_RATIO.fieldNames()
    assert [f.dataType for f in got.schema] == [f.dataType for f in schemas.REGION_RATIO]
    assert rows(got) == [(date(2019, 1, 1), "r", 3, 1, None, 0)]


def test_typed_refuses_values_that_do_not_fit(table):
    df = table("permit string, promo_name int", ("a", 1))
    assert typed(df, "promo").schema["promo_name"].dataType == T.StringType()
    big = table("date date, region string, units double, total_units long, for_sale long, "
                "non_sale long", (None, None, 1e30, 1, 1, 1))
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        typed(big, "region_ratio").collect()


def test_write_replaces(spark, table, tmp_path):
    for name in ("old", "new"):
        back = write_table(table("permit string, promo_name string", ("p", name)),
                           str(tmp_path), "promo")
        assert rows(back) == [("p", name)]


def test_headings(table):
    df = table("record_name string, promo_name string, region string, open_date date, "
               "units int, area double, extra int", ("a", "b", "c", None, 1, 2.0, 3))
    assert with_headings(df, "new_openings").columns == [
        "项目名称", "项目推广名", "区域", "开盘日期", "套数", "面积(㎡)"
    ]


def test_units(table):
    got = with_units(table("stock long, stock_area double", (1200, 3.5)), "stock_kpis")
    assert got.columns == ["库存量", "库存面积"] and rows(got) == [("1200套", "3.5万㎡")]


def test_working_tables_go_where_the_session_says(spark, table, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None) or str(tmp_path)
    with pytest.raises(ZeroDivisionError), WorkingTables(spark, str(tmp_path)) as work:
        folder = Path(work.folder.removeprefix("file:"))
        assert str(folder.parent) == named.removeprefix("file:").rstrip("/")
        assert values(work.keep(table("x int", (1,)), "t")) == [1]
        assert folder.exists()
        1 / 0
    assert not folder.exists()


def test_failed_write_leaves_the_old_table(table, tmp_path):
    write_table(table("permit string, promo_name string", ("p", "old")), str(tmp_path), "promo")
    broken = table("permit string, promo_name string", ("p", "new")).select(
        "permit", F.raise_error(F.lit("broken")).cast("string").alias("promo_name")
    )
    with pytest.raises(Exception, match="broken"):
        write_table(broken, str(tmp_path), "promo")
    assert [p.name for p in tmp_path.iterdir()] == ["promo"]
    again = write_table(table("permit string, promo_name string", ("p", "new")), str(tmp_path), "promo")
    assert rows(again) == [("p", "new")]


def promo(table, name):
    return table("permit string, promo_name string", ("p", name))


@pytest.mark.parametrize("step", ["publish", "switch", "drop_others"])
def test_a_run_that_dies_leaves_a_whole_table(spark, table, tmp_path, monkeypatch, step):
    """Whatever step of the replacement fails, readers find the old table, or the new one."""
    root = str(tmp_path)
    for name in ("older", "old"):
        write_table(promo(table, name), root, "promo")
    opened = read_parquet(spark, root, "promo")

    def die(*_):
        raise OSError("killed")

    monkeypatch.setattr(versions if step == "switch" else sinks, step, die)
    with pytest.raises(OSError, match="killed"):
        write_table(promo(table, "new"), root, "promo")
    monkeypatch.undo()
    left = "new" if step == "drop_others" else "old"
    assert rows(read_parquet(spark, root, "promo")) == [("p", left)]
    assert rows(opened) == [("p", "old")]
    assert rows(write_table(promo(table, "newest"), root, "promo")) == [("p", "newest")]
    assert len(list((tmp_path / "promo").glob("_v-*"))) == 2  # the current one and the one before


def test_leftovers_of_a_killed_run_are_not_read_and_go(spark, table, tmp_path):
    """A process that is killed cleans nothing up."""
    root = str(tmp_path)
    write_table(promo(table, "old"), root, "promo")
    promo(table, "torn").write.parquet(f"{root}/promo/_v-dead/data")
    (tmp_path / "promo" / "_current-dead").write_text("_v-dead")
    assert rows(read_parquet(spark, root, "promo")) == [("p", "old")]
    write_table(promo(table, "new"), root, "promo")
    assert rows(read_parquet(spark, root, "promo")) == [("p", "new")]
    assert {p.name for p in (tmp_path / "promo").iterdir() if "dead" in p.name} == set()


def test_a_table_without_versions_is_read_and_replaced(spark, table, tmp_path):
    root = str(tmp_path)
    promo(table, "plain").write.parquet(f"{root}/promo")
    opened = read_parquet(spark, root, "promo")
    assert rows(opened) == [("p", "plain")]
    write_table(promo(table, "new"), root, "promo")
    assert rows(read_parquet(spark, root, "promo")) == [("p", "new")]
    assert rows(opened) == [("p", "plain")]  # its files stay until the next replacement
    write_table(promo(table, "newer"), root, "promo")
    assert not list((tmp_path / "promo").glob("part-*"))


def odd_areas(table):
    return table("date string, region string, units long, area double",
                 ("2019-01", "r", 1, float("nan")), ("2019-01", "s", 1, float("-inf")), ("2019-01", "t", 1, 2.0),
                 ("2019-01", "u", 1, -2.0), ("2019-01", "v", 1, None), ("2019-01", "w", 1, float("inf")))


def test_doubles_written_here_stay_bare(spark, table, tmp_path):
    """A stored table is marked as free of NaN, so a filter on its doubles reaches the scan."""
    write_table(odd_areas(table), str(tmp_path), "second_hand")
    df = read_parquet(spark, str(tmp_path), "second_hand")
    above, below = df.where(F.col("area") > 0), df.where(~(F.col("area") > 0))
    assert values(above.select("region")) == ["t"] and values(below.select("region")) == ["u"]
    assert sorted(map(str, values(df.select("area")))) == ["-2.0", "2.0", "None", "None", "None", "None"]
    assert "GreaterThan(area,0.0)" in planned(above) and "LessThanOrEqual(area,0.0)" in planned(below)
    again = write_table(df, str(tmp_path), "second_hand")  # what is known stays known
    assert "CASE" not in planned(again) and again.schema["area"].metadata


def test_ranges_reach_tables_that_may_hold_nan(spark, table, tmp_path):
    odd_areas(table).write.parquet(str(tmp_path / "second_hand"))
    read = partial(read_parquet, spark, str(tmp_path), "second_hand")
    for span, regions, pushed in (
        ((-5, None), ["t", "u"], "GreaterThanOrEqual(area,-5.0)"), ((None, 1.5), ["u"], "LessThanOrEqual(area,1.5)"),
        ((2, 2), ["t"], "LessThanOrEqual(area,2.0)"), ((None, None), list("rstuvw"), "[]"),
    ):
        got = read(ranges={"area": span})
        assert sorted(values(got.select("region"))) == regions and pushed in planned(got)


def test_register_views(spark, table):
    register_views({"m2_table": table("v int", (1,))}, prefix="test_")
    assert rows(spark.sql("SELECT v FROM test_m2_table")) == [(1,)]


def test_ratio_view_drops_garbage_dates(table):
    df = table("date string, supply_deal_ratio double",
               ("0000/00/00", 1.0), ("2019/02/01", 2.0), (None, 3.0))
    got = views.land_ratio_view(df).select("date", "month", "supply_deal_ratio")
    assert rows(got) == [("2019-02-01", "2019-02", 2.0)]


def test_all_views_open_over_stored_tables_and_answer_sql(spark, tmp_path):
    for name, schema in schemas.SCHEMAS.items():
        if name in {t for t, _ in catalog.VIEWS.values()}:
            spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    opened = catalog.register(partial(read_parquet, spark, str(tmp_path)))
    assert len(opened) == 29
    for name, picker in pickers.PICKERS.items():
        assert pickers.options(opened, name).columns == [picker.column]
    for name in opened:
        assert spark.sql(f"SELECT * FROM {name}").collect() == []
        spark.catalog.dropTempView(name)


def test_date_filter_on_stored_deals_reaches_the_scan(spark, tmp_path, capsys):
    spark.createDataFrame([], schemas.DEAL_LIST).write.parquet(str(tmp_path / "deal_list"))
    read = partial(read_parquet, spark, str(tmp_path))
    frame = catalog.open_views(read, ["deals"])["deals"]
    deals.deal_kpis(
        frame, regions=["鹿城区"], category="住宅", period=(date(2019, 1, 1), date(2019, 2, 1))
    ).explain("formatted")
    plan = capsys.readouterr().out
    for pushed in ("GreaterThanOrEqual(date,2019-01-01)", "LessThanOrEqual(date,2019-02-01)",
                   "EqualTo(region,鹿城区)", "EqualTo(category,住宅)"):
        assert pushed in plan
    assert "ReadSchema: struct<region:string,units:bigint,area:decimal(28,2),date:date,res_price:" in plan


def test_pickers(table):
    view = table("month string, district string, x int",
                 ("", "a", 1), ("2019-02", None, 1), ("2019-01", "a", 1))
    opened = {"land": view}
    assert [r[0] for r in pickers.options(opened, "land_deal_month").collect()] == [
        "2019-01", "2019-02"
    ]
    assert {r[0] for r in pickers.options(opened, "land_district").collect()} == {"a", None}


def test_all_lists_in_one_pass(spark, table, tmp_path):
    """Ends, missing values and what is chosen at first; one scan serves all lists of a view."""
    view = table("month string, list_month string, district string, parcel_no string, location string, land_use string",
                 ("", "2018-10", "温州市(本级)", "1", None, "a"), ("2019-01", "2018-10", None, "2", None, "b"),
                 ("2019-02", None, "x", "3", None, "b"), (None, "2019-04", "x", "4", None, "a"))
    view.write.parquet(str(tmp_path / "land"))
    stock = table("region string, band string, year int", ("鹿城区", "b1", 2018), ("r", None, 2019), ("r", "b1", None))
    names = [n for n, p in pickers.PICKERS.items() if p.view in ("land", "stock")]
    found = pickers.all_options({"land": spark.read.parquet(str(tmp_path / "land")), "stock": stock}, names)
    got = {n: {} for n in names}
    for r in found.collect():
        got[r.picker][r.value] = r.chosen
    assert got == {
        "land_district": {"温州市(本级)": True, None: False, "x": False}, "land_parcel_no": dict.fromkeys("1234", False),
        "land_location": {None: False}, "land_use": {"a": False, "b": False},
        "land_deal_month": {"2019-01": True, "2019-02": False}, "land_list_month": {"2019-04": True},
        "stock_region": {"鹿城区": True, "r": False}, "stock_band": {"b1": True, None: True},
        "stock_year": {"2018": False, "2019": True},
    }
    lists = planned(pickers.all_options({"land": spark.read.parquet(str(tmp_path / "land"))}, names[:6]))
    assert lists.count("FileScan") <= 2  # the second one, for the ends, is reused
    assert len(pickers.PICKERS) == 25


def test_predicates_split_a_table_without_gaps(spark):
    """Text keys, dates, missing and frequent values: each row has one part, and parts are alike in size."""
    n = 10_000
    key = F.when(F.col("id") % 3 == 0, "O'Hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("k"), F.sha1(F.col("id").cast("string"))))
    day = F.date_add(F.lit(date(2019, 1, 1)), (F.col("id") % 777).cast("int"))
    df = spark.range(n).select("id", key.alias("key"), day.alias("day"), (F.col("id") % 7).alias("n"))
    for column in ("key", "day", "n"):
        bounds, frequent = quantiles(df, column, 8)
        assert len(bounds) <= 8 and frequent == (["O'Hot"] if column == "key" else [])
        parts = range_predicates(column, bounds, frequent)
        sizes = [df.where(p).count() for p in parts]
        assert sum(sizes) == n
        rest = [s for p, s in zip(parts, sizes) if "IS NULL" not in p and "= 'O''Hot'" not in p]
        assert max(rest) <= 2 * n / 7
    ids = range_predicates("id", [2500, 5000, 7500], nullable=False)
    assert ids == ["id < 2500", "id >= 2500 AND id < 5000", "id >= 5000 AND id < 7500", "id >= 7500"]
    parts = range_predicates("key", *[quantiles(df, "key", 8)[0], {"O'Hot": ids}])
    sizes = [df.where(p).count() for p in parts]
    assert sum(sizes) == n and max(sizes) <= n // 6
    assert range_predicates("key", []) == ["key IS NOT NULL", "key IS NULL"]
    assert quantiles(df.where("false"), "key", 4) == ([], [])
    assert literal(date(2019, 1, 2)) == "'2019-01-02'" and literal(datetime(2019, 1, 2, 3)) == "'2019-01-02 03:00:00'"
    with pytest.raises(TypeError):
        literal(object())


def test_jdbc_reads_one_task_for_each_predicate(spark, table, monkeypatch):
    """No database here: what Spark's reader is asked for."""
    asked = {}

    def jdbc(self, url, name, **options):
        asked.update(options, url=url, table=name)
        return promo(table, "x")

    monkeypatch.setattr(DataFrameReader, "jdbc", jdbc)
    parts = range_predicates("permit", ["m"])
    assert rows(read_jdbc(spark, "jdbc:mysql://host/db", "promo", parts, user="u")) == [("p", "x")]
    assert asked == {"url": "jdbc:mysql://host/db", "table": "推广名", "predicates": parts,
                     "properties": {"fetchsize": "10000", "user": "u"}}
