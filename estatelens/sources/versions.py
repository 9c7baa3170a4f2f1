"""Stored tables in versions, so that a table can be replaced without a moment in which it is not there.

    <root>/<table>/_v-<id>/data/...   one complete version
    <root>/<table>/_v-<id>/schema     its columns, which an empty table has no file to tell
    <root>/<table>/_current           the name of the version that readers open

A new version is written beside the old one. Then the pointer is replaced, in one step and
as the last one: a run that dies before it leaves the old table, one that dies after it the
new one. The version that was current before stays until the next replacement, for readers
that have opened it. One writer at a time may replace a table.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = "_current"


def files(spark: SparkSession, path: str):
    """The path and its file system, of the session's Java side."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    target, system = files(spark, path)
    system.delete(target, True)


def new_version() -> str:
    return f"_v-{uuid4().hex}"


def folder_of(path: str, version: str) -> str:
    return f"{path}/{version}/data"


def _read(spark: SparkSession, path: str) -> str | None:
    target, system = files(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    target, system = files(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def pointed(spark: SparkSession, path: str) -> str | None:
    """The current version of the table in ``path``; None for a table without versions."""
    return _read(spark, f"{path}/{POINTER}")


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the current data of the table in ``path``."""
    version = pointed(spark, path)
    return folder_of(path, version) if version else path


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The current data of the table in ``path``, in versions or not."""
    version = pointed(spark, path)
    if not version:
        return spark.read.parquet(path)
    schema = T.StructType.fromJson(json.loads(_read(spark, f"{path}/{version}/schema")))
    return spark.read.schema(schema).parquet(folder_of(path, version))


def publish(spark: SparkSession, path: str, version: str, schema: T.StructType) -> None:
    """Make ``version`` the current one: a new pointer takes the place of the old one."""
    _write(spark, f"{path}/{version}/schema", schema.json())
    beside = f"{path}/{POINTER}-{uuid4().hex}"
    _write(spark, beside, version)
    switch(spark, beside, f"{path}/{POINTER}")


def switch(spark: SparkSession, new: str, old: str) -> None:
    """Rename a file over another one, in one step."""
    source, _ = files(spark, new)
    target, _ = files(spark, old)
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    overwrite = gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(source, target, overwrite)


def drop_others(spark: SparkSession, path: str, *keep: str) -> None:
    """Remove what is in the table's folder besides its pointer and the named versions."""
    table, system = files(spark, path)
    for status in system.listStatus(table):
        if status.getPath().getName() not in (POINTER, *keep):
            system.delete(status.getPath(), True)
