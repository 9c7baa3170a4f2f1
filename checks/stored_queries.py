"""The parcel reports over the typed parcel tables, which are written from the driver's tables first.

Same reports and same SQL as over the parcels with dates as texts.
"""

from __future__ import annotations

import atexit
import tempfile
from functools import cached_property, lru_cache, partial
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from checks.model import PATCHES, PROPER, PUBLIC_USES, RESIDENTIAL_USES, Model, model
from checks.registry import BUILDS, ORACLES, QUERIES, with_columns
from estatelens.plans import parcels
from estatelens.sources import read_parquet
from estatelens.sources.versions import remove

BY_DEAL = (
    "land_query_kpis land_query_table land_area_count_monthly land_res_gfa_far_monthly "
    "land_gfa_count_yearly land_res_gfa_far_yearly land_district_amount_share "
    "land_district_mean_price land_district_area_share land_structure_commercial "
    "land_structure_commercial_proper land_structure_residential "
    "land_structure_residential_proper land_use_mix land_use_mix_proper land_res_area_proper "
    "land_com_area_proper"
).split()
BY_LISTING = (
    "land_listed_area_yearly land_listed_area_monthly land_listed_area_by_district land_open_listings"
).split()


@lru_cache(maxsize=8)
def stored(spark: SparkSession, sf_dir: str) -> str:
    """A folder with both layouts, written once for each session and folder; it goes when Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="parcels-")
    root = f"{shared.rstrip('/')}/parcels-{uuid4().hex}"

    def end() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, root)

    atexit.register(end)
    parcels.store(model(spark, sf_dir).land_raw, root)
    return root


class StoredParcels(Model):
    """As the model, with parcels out of a typed table."""

    def __init__(self, spark: SparkSession, sf_dir: str, layout: str):
        super().__init__(spark, sf_dir)
        self.layout = layout

    @cached_property
    def land(self) -> DataFrame:
        return parcels.open_parcels(
            partial(read_parquet, self.spark, stored(self.spark, self.sf_dir)),
            city_proper=PROPER, residential_uses=RESIDENTIAL_USES,
            public_uses=PUBLIC_USES, location_patches=PATCHES,
        )[self.layout]


def _register(name: str, layout: str) -> None:
    spec, build = BUILDS[name]
    QUERIES[f"stored_{name}"] = lambda spark, sf_dir: with_columns(build(StoredParcels(spark, sf_dir, layout)), spec)
    ORACLES[f"stored_{name}"] = ORACLES[name]


for _name in BY_DEAL:
    _register(_name, "land")
for _name in BY_LISTING:
    _register(_name, "land_listed")
