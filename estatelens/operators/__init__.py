"""DataFrame-to-DataFrame steps."""

from estatelens.operators.categories import category, with_category
from estatelens.operators.changes import change_by_calendar, change_from_previous, with_share
from estatelens.operators.dedup import keep_last, latest_row
from estatelens.operators.domains import distinct_values, domains, newest_value, sorted_values
from estatelens.operators.joins import (
    broadcast_if_small,
    lookup,
    outer_on_keys,
    plain_keys,
    side_by_side,
    tasks_for,
)
from estatelens.operators.ordering import ascending, descending, newest_then_ascending, spread
from estatelens.operators.rollups import pivot_series, rollup_present_keys

__all__ = [
    "ascending", "broadcast_if_small", "category", "change_by_calendar", "change_from_previous",
    "descending", "distinct_values", "domains", "keep_last", "latest_row", "lookup",
    "newest_then_ascending", "newest_value", "outer_on_keys", "pivot_series",
    "plain_keys", "rollup_present_keys", "side_by_side", "sorted_values", "spread",
    "tasks_for", "with_category", "with_share",
]
