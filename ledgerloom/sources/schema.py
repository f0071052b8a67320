"""The canonical multi-ledger GL table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

MONEY = T.DecimalType(20, 4)

# fixed values: the canonical column vocabulary
DATE_COLUMNS = ["transaction_date", "due_date", "value_date"]
TEXT_COLUMNS = [
    "account_code", "account_name", "account_group", "account_type",
    "vendor_name", "customer_name", "party_name",
    "description", "reference_number", "document_number",
    "voucher_type", "transaction_type",
    "cost_centre", "project", "currency_code",
]
AMOUNT_COLUMNS = [
    "debit_amount", "credit_amount", "net_amount",
    "opening_balance", "closing_balance", "exchange_rate",
]

GL_SCHEMA = T.StructType(
    [T.StructField("ledger_id", T.IntegerType()), T.StructField("row_id", T.StringType())]
    + [T.StructField(c, T.DateType()) for c in DATE_COLUMNS]
    + [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    + [T.StructField(c, MONEY) for c in AMOUNT_COLUMNS]
    + [T.StructField("excluded", T.BooleanType())]
)


def conform(df: DataFrame) -> DataFrame:
    """Bring any column subset to the superset schema (absent = typed NULL)."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in GL_SCHEMA
        ]
    )
