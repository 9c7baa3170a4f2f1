"""Group-by helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import sum0


def rollup_present_keys(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Sum the measures per key; rows with a missing key are left out."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(*(sum0(m).alias(m) for m in measures))
    )


def pivot_series(
    df: DataFrame, index: str, series: str, values: Sequence[str], measure: Column
) -> DataFrame:
    """One column per series. The series names are given, so no extra pass."""
    return df.groupBy(index).pivot(series, list(values)).agg(measure)
