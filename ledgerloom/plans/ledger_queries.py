"""The derived ledger itself, row by row, money as double."""

from pyspark.sql import functions as F

from ..sources.trade_ledger import gl_with_excluded
from .ledger_sql import COLUMNS
from .registry import register

MONEY_COLUMNS = {"debit_amount", "credit_amount", "closing_balance", "net_amount"}
ALL = COLUMNS + ["net_amount"]

register(
    "canonical_gl",
    lambda d: gl_with_excluded(d.spark, d.sf_dir).select(
        *[F.col(c).cast("double").alias(c) if c in MONEY_COLUMNS else F.col(c) for c in ALL]),
    "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY_COLUMNS else c for c in ALL) + " FROM gl_all",
    uses=("gl_all",),
)
