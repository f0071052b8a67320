"""Uploaded-file metadata derived from customers and their orders: one file per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.schema_intel import DOC_TYPES
from .trade_ledger import read

# fixed values: header conventions, by c_custkey mod 7
CONVENTIONS = [
    ["Date", "Vch No", "Vch Type", "Particulars", "Debit", "Credit", "Narration"],
    ["Voucher Date", "Reference No", "Voucher Type", "Account Head", "Party Name", "Dr Amount", "Cr Amount", "Description"],
    ["दिनांक", "Vch No", "Voucher Type", "Account Name", "उधार", "जमा", "Narration"],
    ["Date", "Vch No", "Vch Type", "Account", "Party", "Debit", "Credit", "Narration"],
    ["Posting Date", "Document No", "Document Type", "GL Account", "Vendor / Customer", "Dr Amt", "Cr Amt", "Text"],
    ["transaction_date", "reference_number", "voucher_type", "account_name", "party_name", "debit_amount",
     "credit_amount", "description"],
    ["Dt", "VchNo", "VchTyp", "Acct", "Party", "Dr", "Cr", "Narr"],
]
EXTRA = ["Sr No", "Amount", "Vendor", "Opening Balance", "Amount", "Zqwx A", "Zqwx B", "Zqwx C"]


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, position, header), with upper-case, snake-case and misspelt variants."""
    k = F.col("c_custkey")
    names = F.array(*[F.lit(h) for h in CONVENTIONS[-1] + EXTRA])
    for i in range(len(CONVENTIONS) - 1):
        names = F.when(k % 7 == i, F.array(*[F.lit(h) for h in CONVENTIONS[i] + EXTRA])).otherwise(names)
    rows = read(spark, sf_dir, "customer").select(k.alias("file_id"), F.posexplode(names).alias("position", "header"))
    f = F.col("file_id")
    typo = (f % 7 != 2) & (f % 5 == 1) & (F.col("position") == f % 6)
    return rows.withColumn("header", F.when(typo, F.concat("header", F.lit("x"))).when(f % 5 == 2, F.upper("header"))
                           .when(f % 5 == 3, F.regexp_replace("header", " ", "_")).otherwise(F.col("header")))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, position, value) of the three columns no alias knows."""
    o = read(spark, sf_dir, "orders")
    base = F.lit(7) + F.when((F.col("o_custkey") % 7).isin(1, 3, 4, 5, 6), 1).otherwise(0)
    vals = F.array(F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("o_totalprice").cast("decimal(20,2)").cast("string"),
                   F.col("o_orderpriority"))
    return o.select(F.col("o_custkey").alias("file_id"), base.alias("base"), F.posexplode(vals).alias("i", "value")).select(
        "file_id", (F.col("base") + 5 + F.col("i")).alias("position"), "value")


def doc_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, column): two thirds of a document type's columns, in places with a stray one."""
    k = F.col("c_custkey")
    kinds = list(DOC_TYPES.values())
    arr = F.array(*[F.lit(c) for c in kinds[0][0]])
    for i in range(1, len(kinds)):
        arr = F.when(k % 6 == i, F.array(*[F.lit(c) for c in kinds[i][0]])).otherwise(arr)
    arr = F.when(k % 6 == 5, F.array(F.lit("foo"), F.lit("bar"), F.lit("baz"))).otherwise(arr)
    rows = read(spark, sf_dir, "customer").select(k.alias("file_id"), F.posexplode(arr).alias("i", "column"))
    kept = rows.filter((F.col("i") + F.col("file_id")) % 3 != 0).select("file_id", "column")
    stray = read(spark, sf_dir, "customer").filter(k % 7 == 0).select(k.alias("file_id"), F.lit("Narration").alias("column"))
    return kept.unionByName(stray)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, filename, first_date, last_date)."""
    k = F.col("c_custkey")
    yy = F.lpad((k % 30).cast("string"), 2, "0")
    y, y1 = (2000 + k % 30).cast("string"), F.lpad(((k + 1) % 30).cast("string"), 2, "0")
    name = (F.when(k % 8 == 0, F.concat(F.lit("GL_FY"), yy, F.lit(".csv")))
            .when(k % 8 == 1, F.concat(F.lit("ledger Apr-Mar "), y, F.lit(".xlsx")))
            .when(k % 8 == 2, F.concat(F.lit("tds Q3FY"), yy, F.lit(".csv")))
            .when(k % 8 == 3, F.concat(F.lit("gl_"), y, F.lit("-"), y1, F.lit(".csv")))
            .when(k % 8 == 4, F.concat(F.lit("fy-"), y, F.lit(" books.csv")))
            .when(k % 8 == 5, F.concat(F.lit("Apr 24 - Mar "), yy, F.lit(".csv"))).otherwise("export.csv"))
    dates = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first_date"),
        F.max(F.col("o_orderdate").cast("date")).alias("last_date"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(dates, "c_custkey", "left").select(
        k.alias("file_id"), name.alias("filename"), "first_date", "last_date")
