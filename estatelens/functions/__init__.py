"""Column expressions shared by the plans; all of them are Spark built-ins."""

from estatelens.functions.aggregates import (
    count_rows,
    mean,
    ratio_of_sums,
    sum0,
    sum_strict,
    weighted_mean,
)
from estatelens.functions.bands import area_band
from estatelens.functions.dates import (
    as_date,
    first_of_month,
    last_days,
    last_of_previous_month,
    month_key,
    parse_date,
    slash_to_dash,
    year_key,
)
from estatelens.functions.numeric import finite, ratio, round_even, to_number
from estatelens.functions.predicates import (
    between,
    choice,
    days_of,
    floor_bound,
    in_period,
    member,
    not_member,
    positive,
    within,
)
from estatelens.functions.text import (
    number_text,
    or_missing,
    percent_text,
    price_label,
    short_name,
    strip_text,
    with_unit,
)

__all__ = [
    "area_band", "as_date", "between", "choice", "count_rows", "days_of", "finite",
    "first_of_month", "floor_bound", "in_period", "last_days", "last_of_previous_month",
    "mean", "member", "month_key", "not_member", "number_text", "or_missing",
    "parse_date", "percent_text", "positive", "price_label", "ratio",
    "ratio_of_sums", "round_even", "short_name", "slash_to_dash", "strip_text",
    "sum0", "sum_strict", "to_number", "weighted_mean", "with_unit", "within",
    "year_key",
]
