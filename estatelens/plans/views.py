"""Views over the stored tables: parsed dates, derived figures, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.constants import (
    CITY_PROPER,
    EARLIEST_DATE_TEXT,
    LOCATION_PATCHES,
    PUBLIC_USES,
    RESIDENTIAL_USES,
    SQUARE_METRES_PER_THREE_MU,
    TEN_THOUSAND,
)
from estatelens.functions import (
    as_date,
    member,
    month_key,
    not_member,
    number_text,
    or_missing,
    percent_text,
    price_label,
    ratio,
    round_even,
    short_name,
    slash_to_dash,
)
from estatelens.schemas import LAND_DATES


def _ratio_product(a: str, b: str, c: str):
    """a / b * c on doubles."""
    return ratio(a, b) * F.col(c).cast("double")


def region_ratio_view(region_ratio: DataFrame) -> DataFrame:
    return region_ratio.withColumn("short_region", short_name("region"))


def band_ratio_view(region_band_ratio: DataFrame) -> DataFrame:
    return region_band_ratio.withColumn("date", as_date(region_band_ratio, "date"))


def stock_view(region_band_stock: DataFrame) -> DataFrame:
    dated = region_band_stock.withColumn("date", as_date(region_band_stock, "date"))
    return dated.withColumns({"short_region": short_name("region"), "year": F.year("date")})


def project_view(project_name: DataFrame) -> DataFrame:
    return project_name.withColumn("date", as_date(project_name, "open_date"))


def deal_view(deal_list: DataFrame) -> DataFrame:
    return deal_list.withColumns({
        "date": as_date(deal_list, "date"),
        "unit_area": ratio("area", "units"),
        "promo_name": or_missing("promo_name"),
    })


def supply_view(history_supply: DataFrame) -> DataFrame:
    """``on_sale_area`` is in 10,000 square metres, rounded row by row."""
    supply = F.col("total_units") - F.col("non_sale")
    sold_share = round_even(ratio(supply - F.col("for_sale"), supply), 2)
    return history_supply.withColumns({
        "open_date": as_date(history_supply, "open_date"),
        "unit_area": ratio("area", "total_units"),
        "on_sale_area": round_even(
            _ratio_product("area", "total_units", "for_sale") / TEN_THOUSAND, 2
        ),
        "supply": supply,
        "sell_through": sold_share,
        "sell_through_label": percent_text(sold_share),
        "promo_name": or_missing("promo_name"),
        "res_price_label": price_label("res_price"),
        "com_price_label": price_label("com_price"),
    })


def room_view(room: DataFrame) -> DataFrame:
    """The total price is computed before a missing area becomes zero."""
    priced = room.withColumn(
        "total_price", F.col("area").cast("double") * F.col("unit_price").cast("double")
    )
    return priced.withColumns({
        "area": F.coalesce("area", F.lit(0)),
        "status": or_missing("status"),
        "record_name": or_missing("record_name"),
        "total_price_label": F.coalesce(number_text("total_price"), or_missing(F.lit(None))),
    })


def land_view(
    land: DataFrame,
    *,
    city_proper: str = CITY_PROPER,
    residential_uses: Sequence[str] = RESIDENTIAL_USES,
    public_uses: Sequence[str] = PUBLIC_USES,
    location_patches: Mapping[str, str] = LOCATION_PATCHES,
) -> DataFrame:
    """Parcels with month keys, dates, floor prices and three flags.

    ``is_commercial`` means "not a public use" and holds for parcels whose use
    is unknown; the other two flags are then NULL, which no filter lets pass.
    They are plain comparisons, so filters on them reach the scan. Floor prices and the
    area label are derived before a missing site area becomes zero; ``known_area`` stays
    as it is stored.
    """
    floor_area = F.col("max_far") * F.col("site_area")
    mu = round_even(F.col("site_area") / SQUARE_METRES_PER_THREE_MU * 3, 1)
    location = F.col("location")
    for key, place in location_patches.items():
        location = F.when(F.col("detail_url") == key, F.lit(place)).otherwise(location)
    return land.withColumns({
        "month": month_key("deal_time"),
        "list_month": month_key("list_start"),
        **{d: as_date(land, d) for d in LAND_DATES},
        "list_floor_price": round_even(ratio(F.col("start_price") * TEN_THOUSAND, floor_area)),
        "deal_floor_price": round_even(ratio(F.col("deal_price") * TEN_THOUSAND, floor_area)),
        "site_area_label": F.concat(
            number_text("site_area"), F.lit("㎡("), number_text(mu), F.lit("亩)")
        ),
        "location": location,
        "known_area": F.col("site_area"),
        "site_area": F.coalesce("site_area", F.lit(0.0)),
        "is_proper": F.col("district") == city_proper,
        "is_residential": member("land_use", residential_uses),
        "is_commercial": not_member("land_use", public_uses),
    })


def second_hand_view(second_hand: DataFrame) -> DataFrame:
    return second_hand.withColumn("month", month_key("date"))


def land_month_view(report: DataFrame) -> DataFrame:
    """A land report table with dashes in its dates, a month and, where it has
    districts, a short region name."""
    dated = report.withColumn("date", slash_to_dash("date"))
    dated = dated.withColumn("month", month_key("date"))
    if "district" in report.columns:
        dated = dated.withColumn("short_region", short_name("district"))
    return dated


def land_year_view(report: DataFrame) -> DataFrame:
    """A yearly land report table with its date as a date, whatever its notation."""
    return report.withColumn("date", as_date(report, "date"))


def land_ratio_view(report: DataFrame, earliest: str = EARLIEST_DATE_TEXT) -> DataFrame:
    """As :func:`land_month_view`, after dropping rows with a garbage date.

    The dates are compared as text, before their slashes become dashes.
    """
    return land_month_view(report.where(F.col("date") > earliest))
