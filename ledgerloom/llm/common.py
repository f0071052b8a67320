"""Helpers the operators share: stored cuts, row keys, the SQL of words."""

from __future__ import annotations

import ctypes
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word is a run of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Where a missing doc_id stands in every order: after all others.
NO_ID = 2**63 - 1


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return a worker's freed memory to the system: a reused worker idles beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at files every executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def order_id(doc_id: str | Column = "doc_id") -> Column:
    """The id rows are ordered by: a missing one comes last."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def real_id(column: str | Column) -> Column:
    """The inverse of ``order_id``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NO_ID, column)


def word_array(text: str | Column) -> Column:
    """Words of a text; an empty array for a missing or blank one."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
