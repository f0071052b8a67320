"""Session defaults the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the benchmark; ``shared`` (a new temporary folder by default) holds stored tables."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="ledgerloom-"))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, as the cluster names it in ``spark.checkpoint.dir``.

    Only the cluster knows a folder that every executor shares.  Where none is named, a session in one JVM gets a new folder
    below its warehouse, and any other an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return _OWN.setdefault(context.applicationId, f"{warehouse}/checkpoints-{context.applicationId}")
