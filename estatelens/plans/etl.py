"""The batch pipeline: five input tables to five output tables.

    sale_daily ─ category ─ band ─ promo name ─ mean price ──> deal_list
                              └── roll-up ──┐
    supply_raw ─ keep last ─┬ project info ─ promo ─ band ──> history_supply
                            └─ band ─ roll-up ┴─ full outer ─> region_ratio,
                                               region_band_ratio, region_band_stock
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.constants import (
    BAND_EDGES,
    BAND_LABELS,
    NAME_SUFFIX,
    OTHER,
    RESIDENTIAL,
    ROOM_CATEGORY,
    SALE_CATEGORY,
)
from estatelens.functions import area_band, ratio, round_even, strip_text, sum0
from estatelens.operators import (
    broadcast_if_small,
    category,
    keep_last,
    lookup,
    outer_on_keys,
    plain_keys,
    rollup_present_keys,
)
from estatelens.operators.joins import SMALL_ROWS
from estatelens.schemas import DEAL_LIST
from estatelens.sources import LOAD_ORDER, WorkingTables, read_parquet, write_table

PERMIT = ("permit", "record_name")
INFO_COLUMNS = ("delivery", "manager", "land_area", "volume", "far", "green", "presale")


@dataclass(frozen=True)
class Rules:
    """The data-dependent settings of the pipeline."""

    sale_category: Mapping[str, Sequence[str]] = field(default_factory=lambda: SALE_CATEGORY)
    room_category: Mapping[str, Sequence[str]] = field(default_factory=lambda: ROOM_CATEGORY)
    band_edges: Sequence[float] = BAND_EDGES
    band_labels: Sequence[str] = BAND_LABELS
    name_suffix: str = NAME_SUFFIX
    # which of several supply or info rows of one permit is the last one, in tables that
    # were read without their load order
    supply_order: Sequence[str] = ("open_date", "region")
    info_order: Sequence[str] = ("delivery",)

    def last_by(self, df: DataFrame, without: Sequence[str]) -> Sequence[str]:
        """The columns that tell the last row: how the rows were loaded, where that is known."""
        return LOAD_ORDER if set(LOAD_ORDER) <= set(df.columns) else without

    def band(self, area: str, units: str) -> Column:
        return area_band(area, units, self.band_edges, self.band_labels)


@dataclass(frozen=True)
class Inputs:
    """The five input tables."""

    sale_daily: DataFrame
    supply_raw: DataFrame
    promo: DataFrame
    room_price: DataFrame
    project_info: DataFrame

    @classmethod
    def stored(cls, spark: SparkSession, root: str) -> Inputs:
        """The tables under ``root``; the last row of a permit is the one that was loaded last."""
        ordered = ("supply_raw", "project_info")
        return cls(**{
            f.name: read_parquet(spark, root, f.name, load_order=f.name in ordered) for f in fields(cls)
        })


@dataclass(frozen=True)
class PromoNames:
    """Promotion names by permit, counted beforehand, so that sales need not be shuffled for them.

    ``names`` and ``repeats`` (permits with several names, and how many) carry a broadcast
    hint where they are small. ``fan_out`` says whether there are any such permits and
    ``few`` whether they are few.
    """

    names: DataFrame
    repeats: DataFrame
    fan_out: bool
    few: bool

    @classmethod
    def counted(cls, promo: DataFrame, rows: int = SMALL_ROWS) -> PromoNames:
        repeats = promo.groupBy("permit").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        n = repeats.limit(rows + 1).count()
        return cls(
            broadcast_if_small(promo.select("permit", "promo_name"), rows),
            F.broadcast(repeats) if n <= rows else repeats, n > 0, n <= rows,
        )


# --- sales side -------------------------------------------------------------
def sales_with_category(sale_daily: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return sale_daily.withColumn(
        "category", category("category_raw", rules.sale_category, OTHER)
    )


def rooms_with_category(room_price: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return room_price.withColumn("category", category("remark", rules.room_category, RESIDENTIAL))


def mean_room_price(room_price: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Mean price per permit, name and category: sum of totals / sum of areas."""
    complete = room_price.where(F.col("area").isNotNull() & F.col("total_price").isNotNull())
    sums = rollup_present_keys(
        rooms_with_category(complete, rules), [*PERMIT, "category"], ["area", "total_price"]
    )
    return sums.select(
        *PERMIT, "category", ratio("total_price", "area").alias("mean_price")
    )


def with_mean_price(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """Sales with the mean room price; one price row per key, so no fan-out."""
    return lookup(
        sales, prices, {"permit": "permit", "record_name": "record_name", "category": "category"}
    )


def with_promo_name(df: DataFrame, promo: DataFrame | PromoNames) -> DataFrame:
    """Rows with the promotion name; a permit with two names gives two rows."""
    names = promo.names if isinstance(promo, PromoNames) else promo.select("permit", "promo_name")
    return lookup(df, names, {"permit": "permit"})


def banded(df: DataFrame, units: str, rules: Rules) -> DataFrame:
    """Rows with their size band; rows without one are dropped."""
    return df.withColumn("band", rules.band("area", units)).where(F.col("band").isNotNull())


def banded_sales(sale_daily: DataFrame, promo: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Categorised, banded sales with their promotion name.

    All that the roll-ups need: prices do not change the number of rows, so
    they are joined for the deal list only.
    """
    sales = banded(sales_with_category(sale_daily, rules), "units", rules)
    return with_promo_name(sales, promo)


def deal_list(
    inputs: Inputs, rules: Rules = Rules(), promo: PromoNames | None = None
) -> DataFrame:
    """``promo`` stands for the input's promotion names where they were counted before."""
    sales = banded(sales_with_category(inputs.sale_daily, rules), "units", rules)
    priced = with_mean_price(sales, mean_room_price(inputs.room_price, rules))
    return with_promo_name(priced, promo or inputs.promo).select(
        "region",
        "permit",
        strip_text("record_name", rules.name_suffix).alias("record_name"),
        "units",
        "area",
        "date",
        round_even("mean_price", 2).cast(DEAL_LIST["res_price"].dataType).alias("res_price"),
        "promo_name",
        "category",
        "band",
    )


# --- supply side ------------------------------------------------------------
def latest_supply(supply_raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    order = rules.last_by(supply_raw, rules.supply_order)
    return keep_last(supply_raw, PERMIT, order).drop(*LOAD_ORDER)


def with_project_info(
    supply: DataFrame, project_info: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """Supply rows, unique per permit and name, with the last info row.

    The info is reduced to one row per key first, which gives the same rows as
    joining all of them and keeping the last. Joining on the grouped key lets
    the join use the partitioning of the grouping, and tells Spark that the
    info is unique, so that it drops the join for readers who want no info.

    The columns that order the rows hold all of the info, so the last row is the greatest one
    and is carried once.
    """
    keys = plain_keys(*PERMIT)
    order = dict.fromkeys([*rules.last_by(project_info, rules.info_order), *INFO_COLUMNS])
    last = F.max(F.struct(*order)).alias("__info")
    info = project_info.groupBy(*(k.alias(name) for name, k in keys.items())).agg(last)
    return supply.withColumns(keys).join(info, list(keys), "left").select(
        *(supply[c] for c in supply.columns), *(f"__info.{c}" for c in INFO_COLUMNS)
    )


def history_supply(
    supply: DataFrame, project_info: DataFrame, promo: DataFrame | PromoNames, rules: Rules = Rules()
) -> DataFrame:
    """``supply`` is the result of :func:`latest_supply`."""
    described = with_project_info(supply, project_info, rules)
    named = with_promo_name(described, promo)
    return banded(named, "total_units", rules).select(
        "permit", "region", "area", "record_name", "open_date", "total_units", "for_sale",
        "non_sale", "res_price", "com_price", "promo_name", *INFO_COLUMNS, "band",
    )


# --- roll-ups ---------------------------------------------------------------
SUPPLY_MEASURES = ("area", "total_units", "for_sale", "non_sale")


def sales_by_band(sales: DataFrame) -> DataFrame:
    """Banded sales by date, region and band."""
    return rollup_present_keys(sales, ["date", "region", "band"], ["units", "area"])


def weighted_sales_by_band(
    sale_daily: DataFrame, promo: PromoNames, rules: Rules = Rules()
) -> DataFrame:
    """As the roll-up of :func:`banded_sales`, without a shuffle of single sales.

    A sale counts as often as its permit has promotion names. Where no permit has several
    there is nothing to join. A few such permits are broadcast; beyond that sales are first
    summed up by permit, and the sums are joined.
    """
    keys, measures = ["date", "region", "band"], ["units", "area"]
    sales = banded(sale_daily, "units", rules).select("permit", *keys, *measures)
    if not promo.fan_out:
        return rollup_present_keys(sales, keys, measures)
    if not promo.few:
        sales = sales.dropna(subset=keys).groupBy("permit", *keys).agg(*(sum0(m).alias(m) for m in measures))
    counted = lookup(sales, promo.repeats, {"permit": "permit"})
    # repeated rather than multiplied, which would cost decimals their last digits
    again = F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int")))
    return rollup_present_keys(counted.select(*keys, *measures, again.alias("time")), keys, measures)


def supply_by_band(supply: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Supply by opening date, region and band, including rows without a band."""
    rows = supply.dropna(subset=["open_date", "region"]).withColumn(
        "band", rules.band("area", "total_units")
    )
    return (
        rows.groupBy(F.col("open_date").alias("date"), "region", "band")
        .agg(*(sum0(m).alias(m) for m in SUPPLY_MEASURES))
    )


def region_ratio(sold: DataFrame, supplied: DataFrame) -> DataFrame:
    """Units sold and supplied by date and region.

    The two sides differ on purpose: sales count only with a band, supply
    counts with and without one. Both are summed up from the roll-ups by band.
    """
    keys = ["date", "region"]
    return outer_on_keys(
        rollup_present_keys(sold, keys, ["units"]),
        rollup_present_keys(supplied, keys, SUPPLY_MEASURES[1:]),
        keys,
    )


def region_band_ratio(sold: DataFrame, supplied: DataFrame) -> DataFrame:
    keys = ["date", "region", "band"]
    supplied = supplied.where(F.col("band").isNotNull())
    return outer_on_keys(
        sold.select(*keys, "units"), supplied.select(*keys, *SUPPLY_MEASURES[1:]), keys
    )


def region_band_stock(sold: DataFrame, supplied: DataFrame) -> DataFrame:
    """Sold and supplied units and areas; area_y is the area still on sale."""
    keys = ["date", "region", "band"]
    on_sale = round_even(
        ratio("for_sale", "total_units") * F.col("area").cast("double"), 2
    )
    supplied = supplied.where(F.col("band").isNotNull()).withColumn("area_y", on_sale)
    return outer_on_keys(
        sold.select(*keys, "units", F.col("area").alias("area_x")), supplied, keys
    ).select(*keys, "units", "area_x", "for_sale", "area_y", "total_units", "non_sale", "area")


def build(inputs: Inputs, rules: Rules = Rules()) -> dict[str, DataFrame]:
    """All five outputs as lazy DataFrames; only promotion names are counted at once."""
    promo = PromoNames.counted(inputs.promo)
    supply = latest_supply(inputs.supply_raw, rules)
    sold = weighted_sales_by_band(inputs.sale_daily, promo, rules)
    supplied = supply_by_band(supply, rules)
    return {
        "deal_list": deal_list(inputs, rules, promo),
        "history_supply": history_supply(supply, inputs.project_info, promo, rules),
        "region_ratio": region_ratio(sold, supplied),
        "region_band_ratio": region_band_ratio(sold, supplied),
        "region_band_stock": region_band_stock(sold, supplied),
    }


def run(
    spark: SparkSession, inputs: Inputs, root: str, rules: Rules = Rules()
) -> dict[str, DataFrame]:
    """Compute and replace the five output tables under ``root``.

    Every input is read once, but for the promotion names, which are counted first.
    Shared intermediate results are written to shared storage, so losing executors
    costs no recomputation: the deal list is rolled up from its own written table,
    and the supply side and both roll-ups are working tables, which go at the end,
    also after a failure.
    """
    promo = PromoNames.counted(inputs.promo)
    with WorkingTables(spark, f"{root}/_work") as work:
        deals = write_table(
            deal_list(inputs, rules, promo), root, "deal_list", {"year": F.year("date")}, ["date"]
        )

        supply = work.keep(latest_supply(inputs.supply_raw, rules), "supply")
        history = write_table(
            history_supply(supply, inputs.project_info, promo, rules),
            root, "history_supply", {"year": F.year("open_date")}, ["open_date"],
        )

        sold = work.keep(sales_by_band(deals), "sold")
        supplied = work.keep(supply_by_band(supply, rules), "supplied")
        return {
            "deal_list": deals,
            "history_supply": history,
            "region_ratio": write_table(region_ratio(sold, supplied), root, "region_ratio"),
            "region_band_ratio": write_table(
                region_band_ratio(sold, supplied), root, "region_band_ratio"
            ),
            "region_band_stock": write_table(
                region_band_stock(sold, supplied), root, "region_band_stock"
            ),
        }
