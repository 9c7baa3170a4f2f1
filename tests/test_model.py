"""Tables that the checks derive from the driver's: tasks hold a bounded number of line items."""

import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import planned

from checks.model import Model
from estatelens.operators import joins

LINES, ORDERS, PARTS = 900, 90, 9


@pytest.fixture
def small(spark, tmp_path, monkeypatch):
    """Few rows, of which a task may hold 100; a third of the lines belong to one part."""
    monkeypatch.setattr(joins, "TASK_ROWS", 100)

    def write(name, schema, *rows):
        spark.createDataFrame(list(rows), schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("nation", "n_nationkey int, n_name string", (0, "A"), (1, "B"))
    write("customer", "c_custkey long, c_name string, c_nationkey int, c_mktsegment string", *((i, f"c{i}", i % 2, "M") for i in range(4)))
    write("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
          *((i, f"part {i}", "Brand#1", "SMALL", 3, 10.0) for i in range(PARTS)))
    write("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
          *((i, i % 4, "F", 5.0, datetime(2000, 1, 1 + i % 20), "1-URGENT") for i in range(ORDERS)), (None, 1, "F", 5.0, None, None))
    write("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
          "l_returnflag string, l_linestatus string, l_shipdate timestamp",
          *((i % ORDERS, i // ORDERS if i % 3 else 0, i % 7, 1, 2.0, i + 0.25, "RN"[i % 2], "OF"[i % 2], datetime(2001, 1, 1 + i % 9)) for i in range(LINES)),
          (None, None, 1, 1, 2.0, None, None, None, None))
    return Model(spark, str(tmp_path))


def dealt(df, key):
    """Partitions by ``key`` that are asked for by number, with nothing aggregated below them."""
    plan = planned(df)
    found = [m for m in re.finditer(rf"Exchange hashpartitioning\({key}#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert "Aggregate" not in plan[found[0].end():].split("Exchange")[0]
    return {int(m.group(1)) for m in found}


@pytest.mark.parametrize("table, key", [("project_info", "l_partkey"), ("supply_raw", "l_partkey"), ("land_raw", "l_orderkey")])
def test_tasks_grow_with_the_line_items(small, table, key):
    """However well narrow rows compress, a task holds a bounded number of them."""
    assert small.line_tasks == 10
    assert dealt(getattr(small, table), key) == {10}


def line(i):
    return i % ORDERS, (i // ORDERS if i % 3 else 0)


def test_pairs_are_distinct(small):
    found = sorted((r.permit, r.delivery) for r in small.project_info.collect())
    assert found == sorted({(str(line(i)[1]), f"{i % 7:012d}") for i in range(LINES) if line(i)[1] < PARTS})


def test_supply_is_summed_by_part_nation_and_day(small):
    sums = {}
    for i in range(LINES):
        order, part = line(i)
        if part < PARTS:
            key = (str(part), "0%d %s" % (order % 4 % 2, "AB"[order % 4 % 2]), date(2000, 1, 1 + order % 20))
            area, units, open_, returned = sums.get(key, (0, 0, 0, 0))
            sums[key] = area + Decimal(i) + Decimal("0.25"), units + 2, open_ + 2 * (i % 2 == 0), returned + 2 * (i % 2 == 0)
    found = {(r.permit, r.region, r.open_date): (r.area, r.total_units, r.for_sale, r.non_sale) for r in small.supply_raw.collect()}
    assert found == sums


def test_parcels_are_summed_by_order(small):
    found = {r.parcel_no: (r.gfa, r.res_area, r.com_area, r.site_area, r.max_far, r.deal_time) for r in small.land_raw.collect()}
    want = {}
    for order in range(ORDERS):
        mine = [i for i in range(LINES) if line(i)[0] == order]
        f, o = (sum(i + 0.25 for i in mine if i % 2 == odd) for odd in (1, 0))
        last = max(1 + i % 9 for i in mine)
        want[str(order)] = (f + o, f, o, 2.0 * len(mine), float(len(mine)), f"2001-01-{last:02d}")
    assert found == want
