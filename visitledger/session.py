"""Session settings, for this machine and for a cluster."""

from __future__ import annotations

from math import ceil

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "visitledger", folder: str | None = None) -> SparkSession:
    """A UTC session on this machine, for tests and the benchmark.

    `folder` takes the staged tables.

    On a cluster the caller brings the session; none of these settings is needed
    for right results, and dates are UTC dates whatever the session's zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if folder is not None:
        builder = builder.config("spark.checkpoint.dir", f"file://{folder}")
    return builder.getOrCreate()


def cluster_settings(shuffle_bytes: int) -> dict[str, str]:
    """Spark settings for a run whose largest shuffle moves `shuffle_bytes`.

    Adaptive execution merges small shuffle partitions but splits only skewed
    ones, so the count it starts from must suit the data: about 128 MB each,
    small enough to sort in an executor's memory. The largest shuffle is the
    visit history itself, narrowed to the columns the report uses.
    """
    target = 128 * 1024**2
    partitions = max(ceil(shuffle_bytes / target), 200)
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(2 * target),
    }
