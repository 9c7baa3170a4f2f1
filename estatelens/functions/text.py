"""Label columns. Numbers stay numeric; labels are separate text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.constants import MISSING
from estatelens.functions.numeric import column, round_even


def short_name(region: Column | str) -> Column:
    """First two characters of a region name."""
    return F.substring(column(region), 1, 2)


def strip_text(x: Column | str, text: str) -> Column:
    """x without any occurrence of ``text``."""
    return F.replace(column(x), F.lit(text), F.lit(""))


def or_missing(x: Column | str) -> Column:
    """The "no data" label in place of a missing text."""
    return F.coalesce(column(x).cast("string"), F.lit(MISSING))


def number_text(x: Column | str, digits: int = 4) -> Column:
    """A number as plain text, without trailing zeros or an exponent."""
    exact = column(x).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(exact, r"\.?0+$", "") if digits else exact


def with_unit(x: Column | str, unit: str) -> Column:
    return F.concat(number_text(x), F.lit(unit))


def percent_text(share: Column | str) -> Column:
    """0.57 as '57%'."""
    return F.concat(number_text(round_even(column(share) * 100)), F.lit("%"))


def price_label(price: Column | str) -> Column:
    """A price as text, with the "no data" label for a price of zero."""
    price = column(price)
    return F.when(price == 0, F.lit(MISSING)).otherwise(number_text(price))
