"""Land parcels as a typed table, in two layouts.

The database view of the parcels has its dates as texts and its figures with NaN. Here they
are cleaned once, when they are written: dates that can be read become dates, others are
missing, and so are NaN and infinities. The same rows are stored twice, in folders by the
year of the deal and by the year of the listing, each sorted by that day: filters on days,
months, years and prices of the reports then reach the scan of the layout that suits them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions import as_date
from estatelens.operators import tasks_for
from estatelens.plans import views
from estatelens.schemas import LAND_DATES, PARCELS
from estatelens.sources import WorkingTables, conform, normalise_names, write_table

#: table -> (folder of years, day)
LAYOUTS = {"parcels_by_deal": ("deal_year", "deal_time"), "parcels_by_listing": ("list_year", "list_start")}


def clean_parcels(land: DataFrame) -> DataFrame:
    """Parcels, with source or canonical names, in the columns and types of the typed table."""
    rows = conform(normalise_names(land, "land"), "land")
    return rows.withColumns({d: as_date(rows, d) for d in LAND_DATES}).select(*PARCELS.names)


def store(land: DataFrame, root: str) -> dict[str, DataFrame]:
    """Write both layouts under ``root``, replacing older ones; ``land`` is read once.

    Its rows, counted in the working table, say into how many tasks they are dealt for sorting.
    """
    with WorkingTables(land.sparkSession, f"{root}/_work") as work:
        rows = work.keep(clean_parcels(land), "parcels")
        tasks = tasks_for(rows.count())
        return {
            table: write_table(rows, root, table, {folder: F.year(day)}, [day], tasks)
            for table, (folder, day) in LAYOUTS.items()
        }


def open_parcels(read: Callable[[str], DataFrame], **settings) -> dict[str, DataFrame]:
    """The parcel views over both layouts, as ``land`` (by deal) and ``land_listed`` (by listing).

    All land reports take either; figures by listing read less from the second. ``settings``
    go to the view.
    """
    return {
        "land": views.land_view(read("parcels_by_deal"), **settings),
        "land_listed": views.land_view(read("parcels_by_listing"), **settings),
    }
