"""Readers. Connection details always come from the caller."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.functions import as_date, finite
from estatelens.schemas import SOURCE_TABLES
from estatelens.schemas import STORED as SCHEMAS
from estatelens.sources.versions import opened


@dataclass(frozen=True)
class Partitioning:
    """How to split a database table over tasks: stride over one column."""

    column: str
    lower: str | int
    upper: str | int
    parts: int


def _syntactic(name: str) -> str:
    """A name with everything but letters, digits and dots replaced by dots."""
    name = re.sub(r"[^\w.]", ".", name)
    return name if re.match(r"[^\W\d_]", name) else "X" + name


def normalise_names(df: DataFrame, table: str) -> DataFrame:
    """Source column names to canonical ones; others keep their name.

    Source names are recognised as they are and in their syntactic form.
    """
    known = SOURCE_TABLES.get(table, ("", {}))[1]
    known = {_syntactic(source): name for source, name in known.items()} | known
    return df.withColumnsRenamed(
        {c: known.get(c) or known[_syntactic(c)]
         for c in df.columns if c in known or _syntactic(c) in known}
    )


# field metadata of stored columns that were written without NaN and infinities
FINITE = {"finite": True}


def drop_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating point column.

    Columns that are marked as finite in the stored table stay bare.
    """
    fixes = {
        f.name: finite(f.name)
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and not f.metadata.get("finite")
    }
    return df.withColumns(fixes) if fixes else df


# columns that a reader may add to a table or find as its folders
FOLDERS = ("year", "deal_year", "list_year")
LOAD_ORDER = ("load_time", "load_file", "load_row")


def conform(df: DataFrame, table: str) -> DataFrame:
    """The canonical columns of ``table`` in their declared types.

    Columns that have their type already stay bare, so column pruning and
    filter pushdown go through. Text that does not fit a number or date
    becomes NULL; a number that does not fit is an error. The folders that a
    table is stored in stay as columns, for filters on them, and so do the
    columns of the load order.
    """
    schema = SCHEMAS[table]
    extra = [F.col(c) for c in (*FOLDERS, *LOAD_ORDER) if c in df.columns and c not in schema.names]
    return drop_non_finite(df.select(*(_as_declared(df, f) for f in schema), *extra))


def _as_declared(df: DataFrame, field: T.StructField) -> Column:
    if df.schema[field.name].dataType == field.dataType:
        return F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return as_date(df, field.name).alias(field.name)
    have = df.schema[field.name].dataType
    if isinstance(have, T.StringType):
        return F.col(field.name).try_cast(field.dataType).alias(field.name)
    value = finite(field.name) if isinstance(have, (T.DoubleType, T.FloatType)) else F.col(field.name)
    return value.cast(field.dataType).alias(field.name)


def with_load_order(stored: DataFrame) -> DataFrame:
    """Rows of stored files with when and where they were loaded.

    A later file counts as a later load; rows of one file keep their order.
    """
    origin = ("file_modification_time", "file_path", "row_index")
    return stored.withColumns({c: F.col(f"_metadata.{o}") for c, o in zip(LOAD_ORDER, origin)})


def _inside(ranges: Mapping[str, tuple]) -> list[Column]:
    return [
        condition
        for name, (low, high) in ranges.items()
        for condition, bound in ((F.col(name) >= F.lit(low), low), (F.col(name) <= F.lit(high), high))
        if bound is not None
    ]


def _filtered(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return reduce(DataFrame.where, conditions, df)


def read_parquet(
    spark: SparkSession, root: str, table: str, *, load_order: bool = False, ranges: Mapping[str, tuple] | None = None
) -> DataFrame:
    """``<root>/<table>``, with either source or canonical column names.

    Of a table in versions the current one. With ``load_order`` there are columns that tell
    which of several rows was loaded last, for :func:`estatelens.operators.keep_last`.

    ``ranges`` asks for rows whose figures lie between two bounds, both included; None is no
    bound. Stored columns that may hold NaN are cleaned behind a condition, which no filter
    passes; the ranges are asked of the stored values first, where they let too much through
    (NaN counts as large), and again of the clean ones.
    """
    stored = opened(spark, f"{root}/{table}")
    stored = normalise_names(with_load_order(stored) if load_order else stored, table)
    asked = _inside(ranges or {})
    return _filtered(conform(_filtered(stored, asked), table), asked)


def jdbc_options(
    url: str, table: str, partitioning: Partitioning | None, properties: Mapping[str, str]
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **properties}
    if partitioning:
        options |= {
            "partitionColumn": partitioning.column,
            "lowerBound": str(partitioning.lower),
            "upperBound": str(partitioning.upper),
            "numPartitions": str(partitioning.parts),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partitioning: Partitioning | Sequence[str] | None,
    **properties: str,
) -> DataFrame:
    """A canonical table out of a database.

    ``partitioning`` has to be spelled out: a stride over a numeric, date or time column, or
    predicates, one task for each (see ``range_predicates``). Without one the whole table
    comes through a single task, which suits only the small series tables.
    """
    if partitioning is None or isinstance(partitioning, Partitioning):
        options = jdbc_options(url, SOURCE_TABLES[table][0], partitioning, properties)
        rows = spark.read.format("jdbc").options(**options).load()
    else:
        rows = spark.read.jdbc(
            url, SOURCE_TABLES[table][0], predicates=list(partitioning), properties={"fetchsize": "10000", **properties}
        )
    return conform(normalise_names(rows, table), table)


def register_views(tables: Mapping[str, DataFrame], prefix: str = "") -> None:
    """Make the tables known to ``spark.sql``; nothing is read or cached."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
