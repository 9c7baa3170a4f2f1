"""Registration of the queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.model import Model, model
from checks.tables_sql import even, with_tables
from estatelens.functions import round_even

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUILDS: dict[str, tuple[str, Callable[[Model], DataFrame]]] = {}  # column spec and report

_SPARK = {"s": "string", "l": "bigint", "i": "int", "d": "double", "date": "date", "b": "boolean"}
_SQL = {"s": "VARCHAR", "l": "BIGINT", "i": "INTEGER", "d": "DOUBLE", "date": "DATE", "b": "BOOLEAN"}


def _outputs(spec: str) -> list[tuple[str, str, int | None]]:
    """'a b:l c:d2' as (name, kind, digits): a and b whole, c rounded to 2."""
    out, names = [], []
    for word in spec.split():
        name, _, kind = word.partition(":")
        names.append(name)
        if not kind:
            continue
        digits = int(kind[1:]) if kind[0] == "d" and kind[1:].isdigit() else None
        out += [(n, "d" if digits is not None else kind, digits) for n in names]
        names = []
    return out


def with_columns(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*(
        (round_even(n, digits) if digits is not None else F.col(n).cast(_SPARK[kind])).alias(n)
        for n, kind, digits in _outputs(spec)
    ))


def _sql_columns(body: str, spec: str) -> str:
    columns = ", ".join(
        f"{even(n, digits) if digits is not None else f'CAST({n} AS {_SQL[kind]})'} AS {n}"
        for n, kind, digits in _outputs(spec)
    )
    return with_tables(f"SELECT {columns} FROM ({body}) AS result")


def check(name: str, spec: str, sql: str):
    """Register a query. ``spec`` names its columns and their types.

    Sums of doubles are rounded there, as their last digits depend on the
    order of addition in either engine.
    """

    def add(build: Callable[[Model], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: with_columns(build(model(spark, sf_dir)), spec)
        ORACLES[name] = _sql_columns(sql, spec)
        BUILDS[name] = (spec, build)
        return build

    return add
