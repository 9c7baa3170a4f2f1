"""Every registered query next to its SQL, and properties of the plans."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import executed_plan, planned

import __spark_entry__ as driver
from checks import compare
from checks.model import model
from checks.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SMALL)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= driver.queries().keys() and ORACLES.keys() <= driver.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    problems = compare.differences(spark, duck, SMALL, name)
    if problems == ["no rows"]:
        pytest.skip("no rows at this size")
    assert not problems


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_plans_stay_on_the_engine(spark, name):
    """No Python workers, and no cross joins."""
    plan = planned(driver.queries()[name](spark, SMALL))
    for word in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_fused_figures_read_the_parcels_once(spark):
    plan = planned(driver.queries()["land_query_kpis"](spark, SMALL))
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 1


def test_reports_read_only_the_columns_they_need(spark):
    plan = planned(driver.queries()["room_kpis"](spark, SMALL))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_small_lookups_are_broadcast_by_size_and_large_ones_are_not(spark, conf):
    query = driver.queries()["promo_join"]
    assert "BroadcastHashJoin" in executed_plan(query(spark, SMALL))
    conf(
        spark__sql__autoBroadcastJoinThreshold="1k",
        spark__sql__adaptive__autoBroadcastJoinThreshold="1k",
    )
    frame = query(spark, SMALL)
    frame = frame.where("permit is not null")
    assert frame._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2


def test_invariants(spark):
    m = model(spark, MEDIUM)
    assert m.deal_list.count() == m.sale_daily.count()
    sold = m.region_band_stock.agg({"units": "sum"}).first()[0]
    assert sold == m.deal_list.agg({"units": "sum"}).first()[0]
    assert sold == m.region_ratio.agg({"units": "sum"}).first()[0]
    keys = m.sold.select("date", "region", "band").union(
        m.supplied.where("band is not null").select("date", "region", "band")
    )
    assert m.region_band_stock.count() == keys.distinct().count()


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """As if the optional folder were not there, with its pipeline left behind or not."""
    root = Path(driver.__file__).parent
    for name in ("estatelens", "checks"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    script = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *(n for n in e.queries() if n[:2] == 'op'))"
    for pipeline in (True, False):
        left = tmp_path / "corpus_pipeline.py"
        if pipeline and (root / left.name).exists():
            shutil.copy(root / left.name, left)
        else:
            left.unlink(missing_ok=True)
        ran = subprocess.run([sys.executable, "-B", "-c", script], cwd=tmp_path, capture_output=True, text=True, check=True)
        assert ran.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
