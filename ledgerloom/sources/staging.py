"""Derived tables written once to the shared folder and read back many times.

The ledger is an ingested table: it is built once and queried often.  Writing
it cuts the lineage (a lost executor re-reads files, it does not redo the
joins), lets column pruning and predicate pushdown reach parquet, and gives
every later report a plain scan.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha1
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir

T = TypeVar("T")


#: Most rows of a task: so many trade rows, with what is joined to them, are sorted in memory.
TASK_ROWS = 1_000_000


#: The session's least number of splits of a scan; Spark reads it when a scan is run, so it holds for the job, not for a table.
SPLITS = "spark.sql.files.minPartitionNum"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give an input at least one partition per core and, where ``keys`` are named, few enough rows in each to be sorted.

    A file of one row group cannot be split; where that leaves cores idle the rows are dealt out once.  With ``keys`` the scan is asked
    for two splits for each ``TASK_ROWS`` rows (see ``staged``), so that row groups of so many get one each; this moves nothing.  Only
    where a split still holds more than twice as many, its row groups being larger, rows are dealt out by the hash of ``keys``.  An input
    with enough splits is returned as it is.
    """
    spark = df.sparkSession
    cores = tasks = spark.sparkContext.defaultParallelism
    most = 0
    if keys:
        tasks = max(cores, -(-df.count() // TASK_ROWS))  # the count reads footers
        if tasks > cores:
            spark.conf.set(SPLITS, max(2 * tasks, int(spark.conf.get(SPLITS, None) or 0)))
        most = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0  # no column is read
    return df.repartition(tasks, *keys) if most > 2 * TASK_ROWS or df.rdd.getNumPartitions() < cores else df


_BUILT: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a parquet table, written on first use in this application.

    Splits that ``spread`` asks for hold until the table is written.
    """
    app = spark.sparkContext.applicationId
    key = (app, name, source)
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/ledgerloom/{app}/{name}-{sha1(source.encode()).hexdigest()[:12]}"
        splits = spark.conf.get(SPLITS, None)
        try:
            build().write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", 9).parquet(path)
        finally:
            spark.conf.unset(SPLITS) if splits is None else spark.conf.set(SPLITS, splits)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def built(spark: SparkSession, name: str, source: str, build: Callable[[str], T], load: Callable[[str], T]) -> T:
    """A structure of several tables: ``build(path)`` on first use in this application, ``load(path)`` after."""
    app = spark.sparkContext.applicationId
    key = (app, name, source)
    if key in _BUILT:
        return load(_BUILT[key])
    path = f"{shared_dir(spark)}/ledgerloom/{app}/{name}-{sha1(source.encode()).hexdigest()[:12]}"
    made = build(path)
    _BUILT[key] = path
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; cuts the lineage of a loop."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}/{name}-{uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
