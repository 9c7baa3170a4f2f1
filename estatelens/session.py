"""Session settings that the plans profit from."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution is Spark's default; it is spelled out because the plans
# count on it: it picks broadcast joins by the real size of a side, splits hot
# join keys, and merges small shuffle partitions, so that the number of
# shuffle partitions only has to be large enough.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Parquet is compressed: judge the size of a side by its decoded size
    # before it is considered for a broadcast.
    "spark.sql.sources.fileCompressionFactor": "4.0",
}


def cluster_settings(executor_cores: int) -> dict[str, str]:
    """Settings for a cluster with that many cores in total.

    Three shuffle partitions per core to start from; adaptive execution merges
    those that turn out small.
    """
    return SETTINGS | {
        "spark.sql.shuffle.partitions": str(3 * executor_cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "256m",
    }


def local_session(name: str, cpus: int | None = None) -> SparkSession:
    """One machine, for tests and measurements."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        # call sites in error messages cost two round trips per expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
