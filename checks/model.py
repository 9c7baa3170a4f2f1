"""The logical tables of the library, derived from the driver's tables.

Every table exists twice: as a DataFrame built here and as SQL text in
``checks.tables_sql``. The two are written independently of each other.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.constants import COMMERCIAL, NAME_SUFFIX, OTHER, RESIDENTIAL
from estatelens.operators import tasks_for
from estatelens.plans import etl, land_months, views

# Settings that fit the values found in the driver's tables.
RULES = etl.Rules(
    sale_category={RESIDENTIAL: ["ECONOMY", "SMALL"], COMMERCIAL: ["LARGE", "PROMO"]},
    room_category={OTHER: ["MEDIUM"], COMMERCIAL: ["LARGE", "PROMO"]},
    band_edges=(1000, 1500, 2500, 5000),
    band_labels=("b1", "b2", "b3", "b4", "b5"),
)
BANDS = list(RULES.band_labels)
PROPER = "03 NATION_3"
RESIDENTIAL_USES = ["1-URGENT", "3-MEDIUM"]
PUBLIC_USES = ["5-LOW"]
PATCHES = {"goRes(7)": "PATCHED"}
SOLD = ["A", "R"]
REGIONS = [f"{i:02d} NATION_{i}" for i in range(20)]


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _money(name: str) -> Column:
    """Prices as exact numbers, so that sums do not depend on their order."""
    return F.col(name).cast("decimal(18,2)")


@lru_cache(maxsize=8)
def model(spark: SparkSession, sf_dir: str) -> "Model":
    """One model per session and folder, so that plans are built only once.

    Nothing is cached but plans: every query reads its tables again.
    """
    return Model(spark, sf_dir)


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @lru_cache(maxsize=None)
    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def line_tasks(self) -> int:
        """Partitions for line items; the files' footers tell how many there are."""
        return tasks_for(self.read("lineitem").count())

    # --- shared joins -------------------------------------------------------
    @cached_property
    def orders_region(self) -> DataFrame:
        """Orders with date, customer and a nation name that starts with two digits."""
        orders, customer, nation = (self.read(t) for t in ("orders", "customer", "nation"))
        return (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .withColumns({
                "o_date": F.col("o_orderdate").cast("date"),
                "n_name": F.concat(F.lpad(_text("n_nationkey"), 2, "0"), F.lit(" "), "n_name"),
            })
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with order, nation and part."""
        lineitem, part, orders = self.read("lineitem"), self.read("part"), self.orders_region
        return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(
            part, lineitem.l_partkey == part.p_partkey
        )

    # --- inputs of the pipeline ---------------------------------------------
    @cached_property
    def sale_daily(self) -> DataFrame:
        return self.lines.select(
            F.col("n_name").alias("region"),
            _text("l_partkey").alias("permit"),
            F.concat("p_name", F.lit(NAME_SUFFIX)).alias("record_name"),
            F.col("p_type").alias("category_raw"),
            F.col("l_quantity").cast("int").alias("units"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("area"),
            F.col("l_shipdate").cast("date").alias("date"),
        )

    @cached_property
    def supply_raw(self) -> DataFrame:
        quantity, price = F.col("quantity"), F.col("price")
        part = self.read("part")
        orders = self.orders_region.select("o_orderkey", "n_name", "o_date")
        lineitem = self.read("lineitem").select(
            "l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"),
            _money("l_extendedprice").alias("price"), "l_linestatus", "l_returnflag",
        )
        lines = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        # Dealt by part: the groups, of one or two lines each, form where they are summed up,
        # and all of a part lie together, so that the last one can be found before a shuffle.
        dealt = lines.drop("l_orderkey", "o_orderkey").repartition(self.line_tasks, "l_partkey")
        rows = dealt.groupBy("l_partkey", "n_name", "o_date").agg(
            F.sum(price).cast("decimal(10,2)").alias("area"),
            F.sum(quantity).cast("int").alias("total_units"),
            F.sum(F.when(F.col("l_linestatus") == "O", quantity).otherwise(0))
            .cast("int").alias("for_sale"),
            F.sum(F.when(F.col("l_returnflag") == "R", quantity).otherwise(0))
            .cast("int").alias("non_sale"),
        )
        retail = F.col("p_retailprice").cast("decimal(10,2)")
        return rows.join(part, rows.l_partkey == part.p_partkey).select(
            _text("l_partkey").alias("permit"),
            F.col("p_name").alias("record_name"),
            F.col("n_name").alias("region"),
            F.col("o_date").alias("open_date"),
            "area", "total_units", "for_sale", "non_sale",
            retail.alias("res_price"),
            F.when(F.col("p_brand") == "Brand#2", F.lit(0).cast("decimal(10,2)"))
            .otherwise(retail).alias("com_price"),
        )

    @cached_property
    def promo(self) -> DataFrame:
        return self.read("part").select(
            _text("p_partkey").alias("permit"),
            F.nullif("p_brand", F.lit("Brand#1")).alias("promo_name"),
        )

    @cached_property
    def room_price(self) -> DataFrame:
        lineitem, part = self.read("lineitem"), self.read("part")
        return lineitem.join(part, lineitem.l_partkey == part.p_partkey).select(
            _text("l_partkey").alias("permit"),
            F.concat("p_name", F.lit(NAME_SUFFIX)).alias("record_name"),
            F.col("p_type").alias("remark"),
            F.nullif("l_quantity", F.lit(1.0)).cast("decimal(18,4)").alias("area"),
            F.col("l_extendedprice").cast("decimal(18,4)").alias("total_price"),
        )

    @cached_property
    def project_info(self) -> DataFrame:
        """One row per part and supplier that occur together.

        Pairs are dealt by part, into tasks with a bounded number of rows: they get wide when
        the part is joined, and the last one of a part is found among them without a shuffle.
        """
        lineitem, part = self.read("lineitem"), self.read("part")
        pairs = lineitem.select("l_partkey", "l_suppkey").repartition(self.line_tasks, "l_partkey").distinct()
        return pairs.join(part, pairs.l_partkey == part.p_partkey).select(
            _text("l_partkey").alias("permit"),
            F.col("p_name").alias("record_name"),
            F.lpad(_text("l_suppkey"), 12, "0").alias("delivery"),
            F.concat(F.lit("M"), _text("l_suppkey")).alias("manager"),
            F.col("p_retailprice").cast("decimal(15,3)").alias("land_area"),
            F.col("p_type").alias("volume"),
            _text("p_size").alias("far"),
            F.col("p_brand").alias("green"),
            F.lit("presale").alias("presale"),
        )

    @cached_property
    def inputs(self) -> etl.Inputs:
        return etl.Inputs(
            self.sale_daily, self.supply_raw, self.promo, self.room_price, self.project_info
        )

    @cached_property
    def promo_names(self) -> etl.PromoNames:
        return etl.PromoNames.counted(self.promo)

    # --- outputs of the pipeline --------------------------------------------
    @cached_property
    def deal_list(self) -> DataFrame:
        return etl.deal_list(self.inputs, RULES, self.promo_names)

    @cached_property
    def supply_last(self) -> DataFrame:
        return etl.latest_supply(self.supply_raw, RULES)

    @cached_property
    def history_supply(self) -> DataFrame:
        return etl.history_supply(self.supply_last, self.project_info, self.promo_names, RULES)

    @cached_property
    def sold(self) -> DataFrame:
        return etl.weighted_sales_by_band(self.sale_daily, self.promo_names, RULES)

    @cached_property
    def supplied(self) -> DataFrame:
        return etl.supply_by_band(self.supply_last, RULES)

    @cached_property
    def region_ratio(self) -> DataFrame:
        return etl.region_ratio(self.sold, self.supplied)

    @cached_property
    def region_band_ratio(self) -> DataFrame:
        return etl.region_band_ratio(self.sold, self.supplied)

    @cached_property
    def region_band_stock(self) -> DataFrame:
        return etl.region_band_stock(self.sold, self.supplied)

    # --- views --------------------------------------------------------------
    @cached_property
    def deals(self) -> DataFrame:
        return views.deal_view(self.deal_list)

    @cached_property
    def supply(self) -> DataFrame:
        return views.supply_view(self.history_supply)

    @cached_property
    def stock(self) -> DataFrame:
        return views.stock_view(self.region_band_stock)

    @cached_property
    def band_ratio(self) -> DataFrame:
        return views.band_ratio_view(self.region_band_ratio)

    @cached_property
    def ratio(self) -> DataFrame:
        return views.region_ratio_view(self.region_ratio)

    @cached_property
    def projects(self) -> DataFrame:
        rows = self.supply_raw.join(self.promo, "permit").select(
            "record_name", "promo_name", "region",
            F.date_format("open_date", "yyyy/M/d").alias("open_date"),
            F.col("total_units").alias("units"),
            F.col("area").cast("double").alias("area"),
        )
        return views.project_view(rows)

    @cached_property
    def rooms(self) -> DataFrame:
        return views.room_view(self.read("lineitem").select(
            _text("l_partkey").alias("promo_name"),
            F.nullif(_text("l_orderkey"), F.lit("7")).alias("record_name"),
            F.col("l_shipdate").cast("date").alias("sale_date"),
            _text("l_suppkey").alias("building"),
            _text("l_linenumber").alias("room_no"),
            F.nullif("l_returnflag", F.lit("N")).alias("status"),
            F.nullif("l_quantity", F.lit(1.0)).alias("area"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        ))

    @cached_property
    def land_raw(self) -> DataFrame:
        price = F.col("price")
        # Dealt by order first: there is little to combine before the shuffle, and the rows are
        # narrower than partial sums, which would fill each task's memory with open orders.
        lines = self.read("lineitem").select(
            "l_orderkey", F.col("l_shipdate").cast("date").alias("ship_date"), "l_quantity",
            _money("l_extendedprice").alias("price"), "l_linestatus",
        )
        per_order = lines.repartition(self.line_tasks, "l_orderkey").groupBy("l_orderkey").agg(
            F.max("ship_date").alias("last_ship"),
            F.sum("l_quantity").alias("quantity"),
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(price).cast("double").alias("gfa"),
            F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", price)), F.lit(0))
            .cast("double").alias("res_area"),
            F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", price)), F.lit(0))
            .cast("double").alias("com_area"),
        )
        rows = self.orders_region.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        start = F.date_format("o_date", "yyyy-MM-dd")
        end = F.date_format(F.date_add("o_date", 30), "yyyy/M/d")
        return rows.select(
            F.col("o_orderstatus").alias("status"),
            F.col("n_name").alias("district"),
            F.concat(F.lit("P"), _text("o_orderkey")).alias("parcel_name"),
            _text("o_orderkey").alias("parcel_no"),
            F.col("c_mktsegment").alias("location"),
            F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("land_use"),
            start.alias("list_start"),
            end.alias("list_end"),
            end.alias("deposit_end"),
            start.alias("auction_start"),
            end.alias("end_date"),
            F.lit("not yet").alias("terminate_date"),
            F.date_format("o_date", "yyyyMMdd").alias("signup_start"),
            end.alias("signup_end"),
            F.date_format("last_ship", "yyyy-MM-dd").alias("deal_time"),
            F.col("c_name").alias("winner"),
            F.nullif("quantity", F.lit(10.0)).alias("site_area"),
            _text("n_lines").alias("far"),
            F.col("n_lines").cast("double").alias("max_far"),
            "res_area", "com_area", "gfa",
            (F.col("o_totalprice") * 0.9).alias("start_price"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
            .when(F.col("o_orderstatus") == "O", F.lit(0.0)).alias("deal_price"),
            F.lit("30%").alias("density"),
            F.lit("20%").alias("green"),
            F.concat(F.lit("goRes("), _text("o_orderkey"), F.lit(")")).alias("detail_url"),
        )

    @cached_property
    def land(self) -> DataFrame:
        return views.land_view(
            self.land_raw,
            city_proper=PROPER,
            residential_uses=RESIDENTIAL_USES,
            public_uses=PUBLIC_USES,
            location_patches=PATCHES,
        )

    def land_table(self, name: str) -> DataFrame:
        """View of one of the monthly or yearly land tables.

        Dates are stored as text there; but for the ratios, whose filter compares
        texts, they carry slashes.
        """
        table = getattr(land_months, name)(self.land)
        if name == "land_ratio_month":
            return views.land_ratio_view(table, earliest="1997/00/01")
        slashed = table.withColumn("date", F.translate(F.col("date").cast("string"), "-", "/"))
        return views.land_year_view(slashed) if name.endswith("_year") else views.land_month_view(slashed)

    @cached_property
    def second_hand(self) -> DataFrame:
        month = F.date_format(F.trunc("o_date", "MM"), "yyyy-MM-dd").alias("date")
        rows = self.orders_region.groupBy(month, F.col("n_name").alias("region")).agg(
            F.count(F.lit(1)).alias("units"),
            (F.sum(_money("o_totalprice")).cast("double") / 10000).alias("area"),
        )
        return views.second_hand_view(rows)

    # --- series -------------------------------------------------------------
    def _orders_by(self, unit: str, name: str, **measures: Column) -> DataFrame:
        start = F.trunc(F.col("o_orderdate").cast("date"), unit).alias(name)
        return self.read("orders").groupBy(start).agg(
            *(m.cast("double").alias(n) for n, m in measures.items())
        )

    @staticmethod
    def _status(status: str) -> Column:
        return F.col("o_orderstatus") == status

    @cached_property
    def money(self) -> DataFrame:
        price = _money("o_totalprice")
        return self._orders_by(
            "MM", "riqi", m1=F.sum(price), m2=F.sum(F.when(~self._status("P"), price))
        )

    @cached_property
    def reserve_ratio(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self._orders_by(
            "MM", "date",
            large=F.count_if(self._status("F")) / n,
            small_medium=F.count_if(self._status("O")) / n,
        )

    @cached_property
    def lending_rate(self) -> DataFrame:
        return self._orders_by(
            "MM", "date", rate=F.count_if(self._status("P")) / F.count(F.lit(1))
        )

    @cached_property
    def cpi(self) -> DataFrame:
        price = _money("o_totalprice")
        urgent = F.col("o_orderpriority") == "1-URGENT"
        return self._orders_by("MM", "date", loan=F.sum(F.when(urgent, price)), m2=F.sum(price))

    @cached_property
    def income(self) -> DataFrame:
        price = _money("o_totalprice")
        return self._orders_by(
            "year", "date",
            urban=F.sum(F.when(self._status("F"), price)),
            rural=F.sum(F.when(self._status("O"), price)),
        )

    @cached_property
    def cpi_pair(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self._orders_by(
            "year", "riqi",
            national=F.count_if(self._status("F")) / n,
            city=F.count_if(self._status("P")) / n,
        )

    @cached_property
    def city_population(self) -> DataFrame:
        return self._orders_by(
            "year", "date",
            population=F.count_distinct("o_custkey"),
            urban_share=F.count_if(self._status("F")) / F.count(F.lit(1)),
            gdp=F.sum(_money("o_totalprice")),
        )

    @cached_property
    def people(self) -> DataFrame:
        year = F.trunc("o_date", "year").alias("date")
        urban = F.when(F.col("c_mktsegment") == "BUILDING", F.col("o_custkey"))
        return self.orders_region.groupBy(year, F.col("n_name").alias("region")).agg(
            F.count_distinct("o_custkey").cast("double").alias("population"),
            F.count_distinct(urban).cast("double").alias("urban_pop"),
            F.sum(_money("o_totalprice")).cast("double").alias("gdp"),
        )

    @cached_property
    def income_detail(self) -> DataFrame:
        year = F.trunc("o_date", "year").alias("riqi")
        return self.orders_region.groupBy(year, F.col("n_name").alias("region")).agg(
            F.sum(_money("o_totalprice")).cast("double").alias("urban")
        )
