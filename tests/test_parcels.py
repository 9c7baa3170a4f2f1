"""Typed parcel tables: same answers as texts, and filters that reach the scan."""

from datetime import date
from functools import partial

import pytest
from conftest import planned, rows

from estatelens import schemas
from estatelens.plans import land_query, land_reports, parcels, views
from estatelens.sources import read_parquet

MONTHS = ("2018-11", "2019-02")
PERIOD = (date(2018, 11, 5), date(2019, 2, 20))
NAN = float("nan")


def parcel(no, listed, dealt, price, area=100.0, use="普通商品住房用地", ended=None):
    return {
        "district": "温州市(本级)", "parcel_no": str(no), "location": "x", "land_use": use, "list_start": listed,
        "list_end": ended or listed, "deal_time": dealt, "deal_price": price, "start_price": 5.0, "site_area": area,
        "max_far": 2.0, "gfa": 50.0, "res_area": 10.0, "com_area": 20.0,
    }


@pytest.fixture(scope="module")
def land(spark):
    days = ["2018-10-31", "2018-11-01", "2018-11-30", "2019-01-15", "2019-02-28", "2019-03-01", "2017-01-01", None, "not yet"]
    made = [parcel(f"{i}-{j}", d, e, p, a) for i, d in enumerate(days) for j, e in enumerate(days)
            for p, a in ((1.5, 100.0), (0.0, 30.0), (None, None), (NAN, 2e8))]
    made += [parcel("m", "2018-11-05", "2018-11-05", float("inf"), NAN, "教育用地"), parcel("e", "2018-12-01", None, 0.0, ended="2019/2/3")]
    names = schemas.LAND.names
    return spark.createDataFrame([tuple(p.get(n) for n in names) for p in made], schemas.LAND)


@pytest.fixture(scope="module")
def stored(spark, land, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("parcels"))
    written = parcels.store(land, root)
    assert set(written) == set(parcels.LAYOUTS)
    return parcels.open_parcels(partial(read_parquet, spark, root))


@pytest.fixture(scope="module")
def as_texts(land):
    from estatelens.sources import conform

    return views.land_view(conform(land, "land"))


ALL = dict(listed=PERIOD, dealt=PERIOD, min_area="50")
REPORTS = {
    "query_kpis": lambda f: land_query.land_query_kpis(f, **ALL),
    "query_table": lambda f: land_query.land_query_table(f, **ALL),
    "no_bounds": lambda f: land_query.land_query_kpis(f, listed=PERIOD, dealt=PERIOD),
    "area_count": lambda f: land_reports.land_area_count_monthly(f, MONTHS),
    "res_gfa_far": lambda f: land_reports.land_res_gfa_far_monthly(f, MONTHS),
    "gfa_yearly": lambda f: land_reports.land_gfa_count_yearly(f, 2018),
    "res_yearly": lambda f: land_reports.land_res_gfa_far_yearly(f, 2018),
    "listed_yearly": lambda f: land_reports.land_listed_area_yearly(f, 2018),
    "amount_share": lambda f: land_reports.land_district_amount_share(f, "2018-11"),
    "mean_price": lambda f: land_reports.land_district_mean_price(f, ["2018-11", "2019-01"]),
    "area_share": lambda f: land_reports.land_district_area_share(f, []),
    "listed_monthly": lambda f: land_reports.land_listed_area_monthly(f, MONTHS),
    "listed_district": lambda f: land_reports.land_listed_area_by_district(f, MONTHS),
    "commercial": lambda f: land_reports.land_structure_commercial(f, MONTHS, proper=True),
    "residential": lambda f: land_reports.land_structure_residential(f, MONTHS),
    "mix": lambda f: land_reports.land_use_mix(f, MONTHS),
    "open": lambda f: land_reports.land_open_listings(f, date(2019, 3, 10)),
}


# a text that is no date counts as late where years are compared as texts, and is missing in the typed table
def known_dates(frame):
    return frame.where("list_start is not null and deal_time is not null")


@pytest.mark.parametrize("layout", ["land", "land_listed"])
@pytest.mark.parametrize("name", REPORTS)
def test_same_answers_as_over_texts(stored, as_texts, name, layout):
    found, expected = (REPORTS[name](known_dates(f)) for f in (stored[layout], as_texts))
    assert found.columns == expected.columns
    assert sorted(map(repr, rows(found))) == sorted(map(repr, rows(expected)))
    assert rows(expected) or name == "area_share"


DEAL = ["GreaterThanOrEqual(deal_time,2018-11-01)", "LessThanOrEqual(deal_time,2019-02-28)", "GreaterThan(deal_price,0.0)"]
PUSHED = {
    "query_kpis": ["GreaterThanOrEqual(list_start,2018-11-05)", "LessThanOrEqual(deal_time,2019-02-20)",
                   "Or(IsNull(site_area),And(GreaterThanOrEqual(site_area,50.0),LessThanOrEqual(site_area,1.0E8)))"],
    "area_count": DEAL, "res_gfa_far": DEAL, "commercial": DEAL, "residential": DEAL, "mix": DEAL,
    "gfa_yearly": ["GreaterThanOrEqual(deal_time,2018-01-01)", "GreaterThan(deal_price,0.0)"],
    "res_yearly": ["GreaterThanOrEqual(deal_time,2018-01-01)", "GreaterThan(deal_price,0.0)"],
    "listed_yearly": ["GreaterThanOrEqual(list_start,2018-01-01)"],
    "amount_share": ["GreaterThanOrEqual(deal_time,2018-11-01)", "LessThanOrEqual(deal_time,2018-11-30)"],
    "mean_price": ["GreaterThanOrEqual(deal_time,2018-11-01)", "LessThanOrEqual(deal_time,2019-01-31)"],
    "listed_monthly": ["GreaterThanOrEqual(list_start,2018-11-01)", "LessThanOrEqual(list_start,2019-02-28)"],
    "listed_district": ["GreaterThanOrEqual(list_start,2018-11-01)", "LessThanOrEqual(list_start,2019-02-28)"],
    "open": ["GreaterThanOrEqual(list_end,2019-02-23)", "LessThanOrEqual(deal_price,0.0)"],
}
FOLDERS = {"land": {"query_kpis", *PUSHED} - {"listed_yearly", "listed_monthly", "listed_district", "open"},
           "land_listed": {"query_kpis", "listed_yearly", "listed_monthly", "listed_district"}}


@pytest.mark.parametrize("name", PUSHED)
def test_filters_reach_the_scan(stored, capsys, name):
    layout = "land_listed" if name in FOLDERS["land_listed"] - {"query_kpis"} else "land"
    report = REPORTS[name](stored[layout])
    report.explain("formatted")
    plan = capsys.readouterr().out
    for pushed in PUSHED[name]:
        assert pushed in plan, plan
    if name in FOLDERS[layout]:
        assert "PartitionFilters: [isnotnull(" in planned(report)


def test_years_are_folders_of_their_own(spark, land, stored):
    """Only the folders of the asked years are listed, and rows without a day have one, too."""
    assert stored["land"].count() == stored["land_listed"].count() == land.count()
    files = stored["land"].where("deal_year = 2019").inputFiles()
    assert files and stored["land"].where("deal_year is null").count() > 0
    names = {f.split("deal_year=")[1].split("/")[0] for f in stored["land"].inputFiles()}
    assert names >= {"2017", "2018", "2019"}


def test_empty_parcels(spark, land, tmp_path):
    parcels.store(land.where("false"), str(tmp_path))
    views_ = parcels.open_parcels(partial(read_parquet, spark, str(tmp_path)))
    for name, report in REPORTS.items():
        assert report(views_["land"]).count() == ("kpis" in name or name == "no_bounds"), name


def test_rows_without_finite_figures(stored):
    """NaN and infinities are missing: no price above zero, and an area of zero."""
    odd = stored["land"].where("parcel_no = 'm'").select("deal_price", "known_area", "site_area")
    assert rows(odd) == [(None, None, 0.0)]


@pytest.mark.parametrize("days", [1, 40])
def test_layouts_are_sorted_in_tasks_with_a_bounded_number_of_rows(spark, tmp_path, monkeypatch, conf, days):
    """Whatever size of partitions the session asks for, and also where all parcels have one day."""
    from estatelens.operators import joins

    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="1g")
    made = [parcel(i, f"2018-{1 + i % days // 28:02d}-{1 + i % days % 28:02d}", "2018-05-01", 1.5) for i in range(1000)]
    names = schemas.LAND.names
    rows_in = spark.createDataFrame([tuple(p.get(n) for n in names) for p in made], schemas.LAND)
    for table, written in parcels.store(rows_in, str(tmp_path)).items():
        assert sorted(r.parcel_no for r in written.collect()) == sorted(str(i) for i in range(1000))
        day = parcels.LAYOUTS[table][1]
        counts = written.groupBy("_metadata.file_path").agg({"*": "count"}).collect()
        assert len(counts) >= 8 and max(r[1] for r in counts) <= 300, table
        paths = {r.file_path for r in counts}
        for path in paths:
            found = [r[0] for r in spark.read.parquet(path).select(day).collect()]
            assert found == sorted(found)
