"""Size bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.constants import BAND_EDGES, BAND_LABELS
from estatelens.functions.numeric import column, ratio


def area_band(
    area: Column | str,
    units: Column | str,
    edges: Sequence[float] = BAND_EDGES,
    labels: Sequence[str] = BAND_LABELS,
) -> Column:
    """Band of the mean area of one unit.

    The lowest edge belongs to the second band, every other edge to the band
    below it. A positive area over zero units is in the top band; 0/0 and
    missing sizes have no band.
    """
    area, units = column(area), column(units)
    size = ratio(area, units)
    first, *inner = edges
    band = F.when((units == 0) & (area > 0), labels[-1]).when(size < first, labels[0])
    for edge, label in zip(inner, labels[1:-1]):
        band = band.when(size <= edge, label)
    return band.when(size > inner[-1], labels[-1])
