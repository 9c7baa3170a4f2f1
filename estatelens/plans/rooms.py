"""Screen "rooms of one building project"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.constants import HOME_AREA_BOUNDS, SOLD_STATUSES, TEN_THOUSAND
from estatelens.functions import choice, count_rows, member, round_even, sum0, within
from estatelens.operators import spread
from estatelens.schemas import HEADINGS


def chosen_rooms(
    rooms: DataFrame, *, promo_names=None, buildings=None, min_area=None, max_area=None
) -> DataFrame:
    return rooms.where(
        choice("promo_name", promo_names)
        & choice("building", buildings)
        & within("area", min_area, max_area, HOME_AREA_BOUNDS)
    )


def room_kpis(rooms: DataFrame, *, sold_statuses=SOLD_STATUSES, **choices) -> DataFrame:
    """Rooms supplied, rooms sold, area sold (10,000 ㎡)."""
    sold = member("status", sold_statuses)
    return chosen_rooms(rooms, **choices).agg(
        count_rows().alias("supplied"),
        count_rows(sold).alias("sold"),
        round_even(sum0("area", sold) / TEN_THOUSAND, 2).alias("sold_area"),
    )


def room_table(rooms: DataFrame, *, statuses=None, **choices) -> DataFrame:
    """Rooms by building and room number."""
    rows = chosen_rooms(rooms, **choices).where(choice("status", statuses))
    names = list(HEADINGS["room_table"])
    ties = [n for n in names if n not in ("building", "room_no")]
    order = (F.col(n).asc_nulls_last() for n in ("building", "room_no", *ties))
    return spread(rows.select(*names), *order)
