"""Typed sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.functions import finite, round_even, with_unit
from estatelens.schemas import FIGURES, HEADINGS, SCHEMAS, SOURCE_TABLES, STORED
from estatelens.sources.readers import FINITE
from estatelens.sources.versions import drop_others, folder_of, new_version, pointed, publish, remove


def _to(df: DataFrame, field: T.StructField) -> Column:
    have, want = df.schema[field.name].dataType, field.dataType
    value = F.col(field.name)
    if isinstance(want, (T.DoubleType, T.FloatType)):
        known = have == want and df.schema[field.name].metadata.get("finite")
        return value if known else finite(value.cast(want)).alias(field.name, metadata=FINITE)
    if have == want:
        return value
    if isinstance(want, T.IntegralType) and isinstance(have, (T.DoubleType, T.DecimalType)):
        value = round_even(value)
    return value.cast(want).alias(field.name)


def typed(df: DataFrame, table: str) -> DataFrame:
    """The columns of ``table`` in their stored types, in order.

    Counts are rounded, not cut. A value that does not fit its type is an
    error rather than a silent NULL. NaN and infinities become NULL, and the
    columns are marked as free of them, so that readers need not look.
    """
    return df.select(*(_to(df, f) for f in STORED[table]))


def write_table(
    df: DataFrame,
    root: str,
    table: str,
    partition_by: Mapping[str, Column] | None = None,
    sort_by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Replace ``<root>/<table>`` and return it as read back.

    ``partition_by`` adds derived directory columns, such as the year of the
    date. Rows are rebalanced by them first: files come out evenly sized, and
    a directory with most of the rows is written by many tasks. ``sort_by``
    sorts inside each file, so that filters on those columns skip row groups.

    ``tasks`` deals the rows into that many ranges of both instead, by a sample of ``df``,
    which is read twice for it. Whoever has counted the rows bounds by it what a task sorts
    in memory, whatever the session's partition sizes are. Rows that are equal in the order
    may lie in several ranges.

    The new version is written beside the old one, and readers see it when it is
    complete: whenever a run dies, the table is there, old or new (see ``versions``).
    """
    spark = df.sparkSession
    out = typed(df, table)
    path, version = f"{root}/{table}", new_version()
    folders = list(partition_by or {})
    if folders:
        out = out.withColumns(dict(partition_by))
    if tasks:
        row = F.monotonically_increasing_id()
        out = out.withColumn("__row", row).repartitionByRange(tasks, *folders, *sort_by, "__row").drop("__row")
    elif folders:
        out = out.hint("rebalance", *folders)
    if folders or sort_by:
        out = out.sortWithinPartitions(*folders, *sort_by)
    before = pointed(spark, path)
    try:
        out.write.partitionBy(*folders).parquet(folder_of(path, version))
        publish(spark, path, version, out.schema)
    except BaseException:
        if pointed(spark, path) != version:
            remove(spark, f"{path}/{version}")
        raise
    if before:
        drop_others(spark, path, before, version)
    # with its schema, as an empty table leaves no file to infer it from
    return spark.read.schema(out.schema).parquet(folder_of(path, version))


# column types of database tables; a value that doesn't fit one is an error
DATABASE_TYPES = {
    T.StringType(): "VARCHAR(255)", T.IntegerType(): "INTEGER", T.DateType(): "DATE",
    T.LongType(): "INTEGER", T.DecimalType(28, 2): "DECIMAL(10,2)", T.DecimalType(28, 3): "DECIMAL(15,3)",
}


def jdbc_write_options(
    url: str, table: str, connections: int, properties: Mapping[str, str]
) -> dict[str, str]:
    source, renames = SOURCE_TABLES[table]
    names = {canonical: name for name, canonical in renames.items()}
    types = ", ".join(
        f"`{names.get(f.name, f.name)}` "
        + DATABASE_TYPES.get(f.dataType, f.dataType.simpleString().upper())
        for f in SCHEMAS[table]
    )
    return {
        "url": url, "dbtable": source, "numPartitions": str(connections), "batchsize": "10000",
        "createTableColumnTypes": types, **properties,
    }


def write_jdbc(df: DataFrame, url: str, table: str, connections: int, **properties: str) -> None:
    """Replace a database table, under its source names and column types.

    All executors write, over at most ``connections`` connections.
    """
    names = {canonical: name for name, canonical in SOURCE_TABLES[table][1].items()}
    options = jdbc_write_options(url, table, connections, properties)
    out = typed(df, table)
    narrow = {
        f.name: F.col(f.name).cast(DATABASE_TYPES[f.dataType])
        for f in out.schema if isinstance(f.dataType, (T.LongType, T.DecimalType)) and f.dataType in DATABASE_TYPES
    }
    out = out.withColumns(narrow).withColumnsRenamed(names)
    out.write.format("jdbc").options(**options).mode("overwrite").save()


def with_headings(df: DataFrame, report: str) -> DataFrame:
    """The columns of a table report under their display headings."""
    headings = HEADINGS[report]
    return df.select(*(F.col(c).alias(h) for c, h in headings.items()))


def with_units(df: DataFrame, report: str) -> DataFrame:
    """The figures of a one-row report as headed texts with their units."""
    return df.select(*(
        with_unit(name, unit).alias(heading)
        for name, (heading, unit) in FIGURES[report].items()
    ))


class WorkingTables:
    """Written intermediate tables of one run, in a folder of their own that goes with the run.

    They lie in the folder that the cluster names in ``spark.checkpoint.dir``,
    which all executors share; ``fallback`` is used only where none is set and
    should lie next to the output tables.
    """

    def __init__(self, spark: SparkSession, fallback: str):
        self.spark = spark
        folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
        self.folder = f"{folder.rstrip('/')}/work-{uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> WorkingTables:
        return self

    def __exit__(self, *failure) -> None:
        remove(self.spark, self.folder)
