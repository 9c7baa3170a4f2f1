"""The pipeline on small tables, against a plain row-by-row computation."""

import os
import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal
from functools import partial

import pytest
from conftest import planned

from estatelens import schemas
from estatelens.constants import BAND_LABELS, COMMERCIAL, NAME_SUFFIX, OTHER, RESIDENTIAL
from estatelens.plans import catalog, deals, etl, supply, volume_price
from estatelens.sources import LOAD_ORDER, read_parquet

DAY = date(2019, 1, 1)


def make_rows():
    """Random input rows with gaps, repeated keys and missing keys."""
    rng = random.Random(7)
    permits = ["p1", "p2", "p3", "hot", None]

    def permit():
        return "hot" if rng.random() < 0.35 else rng.choice(permits)

    def name():
        return rng.choice(["甲" + NAME_SUFFIX, "乙", "丙" + NAME_SUFFIX])

    def region():
        return rng.choice(["鹿城区", "龙湾区", None])

    def day():
        return None if rng.random() < 0.05 else DAY + timedelta(days=rng.randrange(6))

    def area():
        return None if rng.random() < 0.1 else Decimal(rng.randrange(0, 40_000)).scaleb(-2)

    def units():
        return rng.choice([0, 1, 1, 2, 3, None])

    sale = [
        (region(), permit(), name(), rng.choice(["住宅", "商铺", "车位", None]), units(), area(), day())
        for _ in range(300)
    ]
    supply = [
        (permit(), name(), region(), day(), area(), rng.choice([0, 1, 2, 4]), rng.choice([0, 1, None]),
         rng.choice([0, 1]), Decimal("9000.00"), Decimal("0.00"))
        for _ in range(60)
    ]
    # a definite last row: opening day and region are unique inside a key
    seen, unique = set(), []
    for row in supply:
        if (row[0], row[1], row[3], row[2]) not in seen:
            seen.add((row[0], row[1], row[3], row[2]))
            unique.append(row)
    promo = [("p1", "春"), ("p1", "夏"), ("hot", "秋"), (None, "冬"), ("other", "空")]
    price = [
        (permit(), name(), rng.choice(["住宅", "车位", "商铺", None]),
         rng.choice([None, Decimal(100), Decimal(80), Decimal(0)]),
         rng.choice([None, Decimal(1_000_000), Decimal(950_000)]))
        for _ in range(200)
    ]
    info = [
        (p, n, f"2020-0{i}", "管", Decimal("12.500"), "v", "2.0", "30%", "s")
        for i, (p, n) in enumerate([("p1", "乙"), ("p1", "乙"), (None, "乙"), ("hot", "乙")])
    ]
    return sale, unique, promo, price, info


@pytest.fixture(scope="module")
def data(spark):
    sale, supply, promo, price, info = make_rows()

    def frame(rows, schema, parts=4):
        return spark.createDataFrame(rows, schema).repartition(parts).cache()

    inputs = etl.Inputs(
        frame(sale, schemas.SALE_DAILY), frame(supply, schemas.SUPPLY_RAW),
        frame(promo, schemas.PROMO), frame(price, schemas.ROOM_PRICE),
        frame(info, schemas.PROJECT_INFO),
    )
    return (sale, supply, promo, price, info), inputs


def band(area, units):
    if area is None or units is None:
        return None
    area = float(area)
    if units == 0:
        return BAND_LABELS[-1] if area > 0 else None
    size = area / units
    limits = [size < 90, size <= 120, size <= 144, size <= 180, True]
    return BAND_LABELS[limits.index(True)]


def last_supply(supply):
    def order(row):
        return (row[3] is not None, row[3] or DAY, row[2] is not None, row[2] or "")

    best = {}
    for row in supply:
        key = row[:2]
        if key not in best or order(row) > order(best[key]):
            best[key] = row
    return list(best.values())


def expected_deals(sale, promo, price):
    sums = defaultdict(lambda: [0.0, 0.0])
    room = {"住宅": RESIDENTIAL, "商铺": COMMERCIAL, "车位": OTHER, None: RESIDENTIAL}
    for permit, name, remark, area, total in price:
        if None not in (permit, name, area, total):
            sums[permit, name, room[remark]][0] += float(area)
            sums[permit, name, room[remark]][1] += float(total)
    kinds = {"住宅": RESIDENTIAL, "商铺": COMMERCIAL, "车位": OTHER, None: OTHER}
    out = []
    for region, permit, name, raw, units, area, day in sale:
        size = band(area, units)
        if size is None:
            continue
        total = sums.get((permit, name, kinds[raw]))
        mean = Decimal(f"{total[1] / total[0]:.2f}") if total and total[0] else None
        for promo_name in [n for p, n in promo if p == permit] or [None]:
            out.append((region, permit, name.replace(NAME_SUFFIX, ""), units, area, day, mean,
                        promo_name, kinds[raw], size))
    return out


def text(rows):
    """Sorted rows; a number looks the same with any number of zeros at its end."""
    def plain(x):
        return x.normalize() + 0 if isinstance(x, Decimal) else x

    return sorted(repr(tuple(map(plain, r))) for r in rows)


def test_deal_list(data):
    (sale, _, promo, price, _), inputs = data
    assert text(etl.deal_list(inputs).collect()) == text(expected_deals(sale, promo, price))


def test_latest_supply(data):
    (_, supply, *_), inputs = data
    assert text(etl.latest_supply(inputs.supply_raw).collect()) == text(last_supply(supply))


def test_history_supply(data):
    (_, supply, promo, _, info), inputs = data
    last_info = {}
    for row in sorted(info, key=lambda r: r[2]):
        last_info[row[:2]] = row[2:]
    expected = []
    for permit, name, region, day, area, total, for_sale, non_sale, res, com in last_supply(supply):
        if band(area, total) is None:
            continue
        for promo_name in [n for p, n in promo if p == permit] or [None]:
            expected.append((permit, region, area, name, day, total, for_sale, non_sale, res, com,
                             promo_name, *last_info.get((permit, name), (None,) * 7),
                             band(area, total)))
    got = etl.history_supply(
        etl.latest_supply(inputs.supply_raw), inputs.project_info, inputs.promo
    )
    assert got.columns == [f.name for f in schemas.HISTORY_SUPPLY]
    assert text(got.collect()) == text(expected)


def add_up(rows, key, measures):
    sums = {}
    for row in rows:
        k = key(row)
        if None in k:
            continue
        old = sums.setdefault(k, [0] * len(measures))
        sums[k] = [a + (row[i] or 0) for a, i in zip(old, measures)]
    return sums


def test_rollups(data):
    (sale, supply, promo, price, _), inputs = data
    deals = expected_deals(sale, promo, price)
    supplies = last_supply(supply)
    built = etl.build(inputs)

    sold = add_up(deals, lambda r: (r[5], r[0]), [3])
    supplied = add_up(supplies, lambda r: (r[3], r[2]), [5, 6, 7])
    expected = [
        (*k, *sold.get(k, [None]), *supplied.get(k, [None] * 3)) for k in sold.keys() | supplied
    ]
    assert text(built["region_ratio"].collect()) == text(expected)

    sold = add_up(deals, lambda r: (r[5], r[0], r[9]), [3, 4])
    supplied = add_up(supplies, lambda r: (r[3], r[2], band(r[4], r[5])), [5, 6, 7, 4])
    expected = [
        (*k, sold.get(k, [None])[0], *supplied.get(k, [None] * 4)[:3])
        for k in sold.keys() | supplied
    ]
    assert text(built["region_band_ratio"].collect()) == text(expected)

    def stock(k):
        units, area_x = sold.get(k, [None, None])
        total, for_sale, non_sale, area = supplied.get(k, [None] * 4)
        area_y = round(for_sale / total * float(area), 2) if total else None
        return (*k, units, area_x, for_sale, area_y, total, non_sale, area)

    def plain(rows):
        return text([float(x) if isinstance(x, (int, Decimal)) else x for x in r] for r in rows)

    got = built["region_band_stock"].collect()
    assert plain(got) == plain(stock(k) for k in sold.keys() | supplied)


def test_supply_counts_without_band_only_in_the_region_ratio(spark, data):
    _, inputs = data
    supply = spark.createDataFrame(
        [("p", "n", "r", DAY, None, 5, 3, 1, None, None)], schemas.SUPPLY_RAW
    )
    supplied = etl.supply_by_band(supply)
    sold = etl.sales_by_band(etl.banded_sales(inputs.sale_daily, inputs.promo)).limit(0)
    assert [tuple(r) for r in etl.region_ratio(sold, supplied).collect()] == [
        (DAY, "r", None, 5, 3, 1)
    ]
    assert etl.region_band_ratio(sold, supplied).collect() == []


def test_run_writes_typed_tables_that_equal_the_lazy_ones(spark, data, tmp_path):
    _, inputs = data
    lazy = etl.build(inputs)
    written = etl.run(spark, inputs, str(tmp_path))
    for name, df in written.items():
        schema = schemas.SCHEMAS[name]
        stored = df.select(*schema.fieldNames())
        assert [(f.name, f.dataType) for f in stored.schema] == [
            (f.name, f.dataType) for f in schema
        ], name
        wanted = lazy[name].select(*(lazy[name][f.name].cast(f.dataType) for f in schema))
        assert text(stored.collect()) == text(wanted.collect()), name
    again = etl.run(spark, inputs, str(tmp_path))
    assert again["deal_list"].count() == lazy["deal_list"].count()


def test_run_prunes_directories_by_year(spark, data, tmp_path):
    _, inputs = data
    written = etl.run(spark, inputs, str(tmp_path))["deal_list"]
    assert "PartitionFilters: [isnotnull(year" in planned(written.where("year = 2019"))


def test_reports_prune_directories_by_their_period(spark, data, tmp_path):
    """A date range alone is enough, and reading back gives the columns of writing."""
    _, inputs = data
    written = etl.run(spark, inputs, str(tmp_path))
    read = partial(read_parquet, spark, str(tmp_path))
    assert sorted(read("deal_list").columns) == sorted(written["deal_list"].columns)
    views = catalog.open_views(read, ["deals", "supply"])
    period, regions = (date(2019, 1, 1), date(2019, 6, 30)), ["鹿城区"]
    for report in (
        deals.deal_kpis(views["deals"], regions=regions, category="住宅", period=period),
        supply.supply_kpis(views["supply"], regions=regions, period=period),
        supply.supply_sale_kpis(views["supply"], views["deals"], regions=regions, period=period),
        volume_price.units_by_band(views["deals"], period=period),
    ):
        plan = planned(report)
        assert plan.count("PartitionFilters: [isnotnull(year") == plan.count("FileScan")


def test_large_and_fine_numbers_pass_unchanged(spark, tmp_path):
    """Nothing is rounded before it is banded, nothing large gets lost."""
    rows = [("r", "p", "n", "x", 1, 120.004, "2019-01-01"), ("r", "q", "n", "x", 2**33, 123456789.5, "2019-01-01"),
            ("r", "s", "n", "x", 1, float("nan"), "2019-01-01"), ("r", "t", "n", "x", 1, 1e11, "2019-01-01")]
    sale = "region string, permit string, record_name string, category_raw string, units long, area double, date string"
    spark.createDataFrame(rows, sale).write.parquet(str(tmp_path / "in" / "sale_daily"))
    for name in ("supply_raw", "promo", "room_price", "project_info"):
        spark.createDataFrame([], schemas.SCHEMAS[name]).write.parquet(str(tmp_path / "in" / name))
    read = partial(read_parquet, spark, str(tmp_path / "in"))
    inputs = etl.Inputs(*(read(t) for t in ("sale_daily", "supply_raw", "promo", "room_price", "project_info")))
    found = etl.run(spark, inputs, str(tmp_path / "out"))
    assert {r.permit: (r.units, r.area, r.band) for r in found["deal_list"].collect()} == {
        "p": (1, Decimal("120.00"), "120-144㎡面积"), "q": (2**33, Decimal("123456789.50"), "小于90㎡面积"),
        "t": (1, Decimal("100000000000.00"), "180㎡以上面积"),
    }
    sold = found["region_band_stock"].where("band = '小于90㎡面积'").first()
    assert (sold.units, sold.area_x) == (2**33, Decimal("123456789.50"))


def test_rollups_need_no_prices(data):
    _, inputs = data
    sold = etl.sales_by_band(etl.banded_sales(inputs.sale_daily, inputs.promo))
    assert planned(sold).count("Join") == 1


def test_project_info_is_joined_on_the_grouped_key(spark, data, conf):
    """Joining the last info row adds no exchange to the one that found it."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    _, inputs = data
    joined = etl.with_project_info(inputs.supply_raw, inputs.project_info)
    assert planned(joined).count("Exchange hashpartitioning") == 2


def test_project_info_that_nobody_reads_is_not_joined(data):
    _, inputs = data
    joined = etl.with_project_info(inputs.supply_raw, inputs.project_info)
    assert "Join" not in planned(joined.select("permit", "total_units"))


def test_weighted_rollup_equals_the_joined_one(data):
    """No repeated permits, a few, or too many of them to broadcast: the same sums, digit by digit."""
    _, inputs = data
    for promo in (inputs.promo, inputs.promo.where("permit <> 'p1'"), inputs.promo.where("false"),
                  inputs.promo.unionAll(inputs.promo)):
        wanted = text(etl.sales_by_band(etl.banded_sales(inputs.sale_daily, promo)).collect())
        for rows in (0, 2, 1000):
            counted = etl.PromoNames.counted(promo, rows)
            got = etl.weighted_sales_by_band(inputs.sale_daily, counted)
            assert got.columns == ["date", "region", "band", "units", "area"]
            assert text(got.collect()) == wanted


def test_single_sales_are_not_shuffled_for_promotion_names(data, conf):
    """One exchange, of sums; the deal list shuffles sales once, for their prices."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    _, inputs = data
    counted = etl.PromoNames.counted(inputs.promo)
    plan = planned(etl.weighted_sales_by_band(inputs.sale_daily, counted))
    before_exchange = plan.split("Exchange hashpartitioning(date")[1]
    assert plan.count("Exchange hashpartitioning") == 2  # sums of sales, and counts of the promotion names
    assert "SortMergeJoin" not in plan and "partial_sum" in before_exchange
    few = planned(etl.weighted_sales_by_band(inputs.sale_daily, etl.PromoNames.counted(inputs.promo, 0)))
    assert few.index("SortMergeJoin") < few.rindex("partial_sum")  # sums by permit are joined, not sales
    joined = planned(etl.deal_list(inputs))
    once = planned(etl.deal_list(inputs, promo=counted))
    assert joined.count("SortMergeJoin") == 2 and once.count("SortMergeJoin") == 1
    assert joined.count("Exchange hashpartitioning") - once.count("Exchange hashpartitioning") == 2


def test_hot_permit_without_broadcast(spark, conf, data):
    """Too many permits with several names: sums of a hot permit are joined, and split if need be."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    _, inputs = data
    sale = inputs.sale_daily
    many = sale.unionAll(sale.where("permit = 'hot'")).unionAll(sale.where("permit = 'hot'"))
    promo = inputs.promo.unionAll(inputs.promo.where("permit = 'hot'"))
    wanted = etl.sales_by_band(etl.banded_sales(many, promo))
    got = etl.weighted_sales_by_band(many, etl.PromoNames.counted(promo, 0))
    assert text(got.collect()) == text(wanted.collect())


def test_the_row_that_was_loaded_last_counts(spark, tmp_path):
    """Two loads: whatever a row says, the later load wins, and in one file the later row."""
    def write(name, rows, load, modified):
        folder = tmp_path / name
        spark.createDataFrame(rows, schemas.SCHEMAS[name]).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*"):
            if f.name not in load:
                os.utime(f, (modified, modified))
                load.add(f.name)

    def supply_row(permit, opened, units):
        return (permit, "n", "r", opened, Decimal("100"), units, 0, 0, None, None)

    def info_row(permit, delivery):
        return (permit, "n", delivery, "m", None, "v", "f", "g", "s")

    loads = {"supply_raw": set(), "project_info": set()}
    # loaded first: later days and greater texts than the load that follows
    write("supply_raw", [supply_row("p", date(2020, 1, 1), 9), supply_row("q", date(2020, 1, 1), 9)], loads["supply_raw"], 1_000_000)
    write("project_info", [info_row("p", "2029"), info_row("q", "2021"), info_row("q", "2020")], loads["project_info"], 1_000_000)
    write("supply_raw", [supply_row("p", date(2019, 1, 1), 5), supply_row("p", date(2018, 1, 1), 4)], loads["supply_raw"], 2_000_000)
    write("project_info", [info_row("p", "2018"), info_row("p", None)], loads["project_info"], 2_000_000)
    for name in ("sale_daily", "promo", "room_price"):
        spark.createDataFrame([], schemas.SCHEMAS[name]).write.parquet(str(tmp_path / name))
    inputs = etl.Inputs.stored(spark, str(tmp_path))
    assert set(LOAD_ORDER) <= set(inputs.supply_raw.columns)
    last = etl.latest_supply(inputs.supply_raw)
    assert last.columns == schemas.SUPPLY_RAW.names
    assert sorted((r.permit, r.total_units) for r in last.collect()) == [("p", 4), ("q", 9)]
    found = etl.run(spark, inputs, str(tmp_path / "out"))["history_supply"].collect()
    assert sorted((r.permit, r.total_units, r.delivery) for r in found) == [("p", 4, None), ("q", 9, "2020")]
    # without the load order the declared columns decide, as before
    plain = etl.latest_supply(read_parquet(spark, str(tmp_path), "supply_raw"))
    assert sorted((r.permit, r.total_units) for r in plain.collect()) == [("p", 9), ("q", 9)]


def test_last_info_row_is_carried_once(data):
    """Each task sorts its info rows to find the last ones; its result holds the info once."""
    _, inputs = data
    plan = planned(etl.with_project_info(inputs.supply_raw, inputs.project_info))
    assert "partial_max(struct(delivery" in plan and "max_by" not in plan
