"""Raw tax documents derived from the trade tables: text columns under foreign headers.

They carry seeded faults by key modulus (malformed PANs, swapped tax splits,
missing invoices, ...), so the document checks have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schema import MONEY
from .staging import spread
from .trade_ledger import read

# fixed values: TDS section by l_linenumber 1..7 with (company rate, individual rate)
SECTION_BY_LINE = ["194C", "194J", "194H", "194I", "194A", "999Z", "192"]
RATE_BY_LINE = ["0.02", "0.10", "0.05", "0.10", "0.10", "0.10", "0.05"]


def _text(c: Column) -> Column:
    return c.cast("decimal(20,2)").cast("string")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def form_26q_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_extendedprice").cast(MONEY).alias("ext"), F.col("l_shipdate").cast("date").alias("day"))
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    k, s, n = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rate = F.lit("0.02").cast("decimal(6,4)")
    section = F.lit(None).cast("string")
    for i in range(7):
        rate = F.when(n == i + 1, F.lit(RATE_BY_LINE[i]).cast("decimal(6,4)")).otherwise(rate)
        section = F.when(n == i + 1, F.lit(SECTION_BY_LINE[i])).otherwise(section)
    full = F.round(F.col("ext") * rate, 2)
    deducted = F.when(k % 11 == 3, F.lit(0)).when(k % 5 == 0, F.round(full / 2, 2)).otherwise(full).cast("decimal(20,2)")
    pan = (F.when(s % 10 == 9, "").when(s % 10 == 7, F.concat(F.lit("ABCD"), _pad(s % 10000, 4), F.lit("F")))
           .otherwise(F.concat(F.lit("abcde"), _pad(s % 10000, 4), F.lit("F"))))
    name = (F.when(s % 4 == 1, F.concat("s_name", F.lit(" Pvt. Ltd")))
            .when(s % 4 == 2, F.concat("s_name", F.lit(" Traders"))).otherwise(F.col("s_name")))
    return spread(line).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("ledger_id"),
        F.concat_ws("-", k, n, "l_partkey", s).alias("row_key"),
        name.alias("Name of Deductee"), pan.alias("PAN"),
        F.when(s % 2 == 0, "Company").otherwise("Individual").alias("Deductee Type"),
        section.alias("Section"), F.lit("Payment to supplier").alias("Particulars"),
        _text(F.col("ext")).alias("Amount Paid"), deducted.cast("string").alias("TDS Deducted"),
        F.when(k % 13 == 0, F.lit("")).when(k % 13 == 1, _text(F.round(deducted / 2, 2)))
        .otherwise(deducted.cast("string")).alias("TDS Deposited"),
        F.when(k % 17 == 5, "").when(s % 10 == 3, "12AB").otherwise(_pad(s % 10000000, 7)).alias("BSR Code"),
        F.date_format(F.date_add("day", 7), "dd/MM/yyyy").alias("Challan Date"),
        _pad(k % 100000, 5).alias("Challan No"),
        F.date_format("day", "yyyy-MM-dd").alias("Date of Payment"),
        F.when(k % 19 == 7, "LDC-1").otherwise("").alias("Cert No"))


def gstr1_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_totalprice").cast(MONEY).alias("price"),
        F.col("o_orderdate").cast("date").alias("day")).filter(F.col("k") % 61 != 0)
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k, c, nation = F.col("k"), F.col("c_custkey"), F.col("c_nationkey")
    copies = (F.when(k % 59 == 0, F.array(F.lit(1), F.lit(2))).when(k % 67 == 9, F.array(F.lit(1), F.lit(3)))
              .otherwise(F.array(F.lit(1))))
    rows = spread(orders).join(cust, F.col("o_custkey") == F.col("c_custkey")).withColumn("copy", F.explode(copies))
    tax = F.round(F.col("price") * F.lit("0.09").cast("decimal(4,2)"), 2).cast("decimal(20,2)")
    tax = F.when(k % 89 == 1, F.round(tax * F.lit("1.07").cast("decimal(4,2)"), 2).cast("decimal(20,2)")).otherwise(tax)
    rows = rows.withColumn("tax", tax)
    intra = (nation == 24) != (k % 53 == 0)
    zero, mixed = k % 109 == 2, k % 113 == 3
    nil = F.lit(0).cast("decimal(20,2)")
    half = F.when(zero, nil).when(intra | mixed, F.col("tax")).otherwise(nil)
    igst = F.when(zero, nil).when(~intra | mixed, F.col("tax") * 2).otherwise(nil).cast("decimal(20,2)")
    state = _pad(nation + 3, 2)
    return rows.select(
        nation.alias("ledger_id"), F.concat_ws("-", k, "copy").alias("row_key"),
        F.concat(F.when(F.col("copy") == 2, "EXT-").when(k % 71 == 5, " inv-").otherwise("INV-"), k).alias("Invoice No"),
        F.date_format("day", "dd-MM-yyyy").alias("Invoice Date"),
        _text(F.col("price") + 2 * F.col("tax")).alias("Invoice Value"),
        F.when(c % 10 == 9, "").when(c % 10 == 7, F.concat(state, F.lit("BAD"), c))
        .otherwise(F.concat(state, F.lit("ABCDE"), _pad(c % 10000, 4), F.lit("F1Z5"))).alias("Buyer_GSTIN"),
        F.when(k % 47 == 3, "Totally Different Trader").otherwise(F.col("c_name")).alias("Buyer Name"),
        F.when(k % 103 == 1, "").when(k % 101 == 9, "98-Nowhere").otherwise(F.concat(state, F.lit("-State")))
        .alias("POS"),
        _text(F.col("price")).alias("Taxable Value"), igst.cast("string").alias("IGST_Amt"),
        half.cast("string").alias("CGST_Amt"), half.cast("string").alias("SGST_Amt"), F.lit("").alias("Cess"),
        F.when(k % 97 == 4, "export").when(zero & (k % 2 == 0), "nil").otherwise("").alias("Type of Supply"),
        F.when(k % 7 == 3, "").otherwise("8471").alias("HSN"),
        F.when(k % 83 == 6, "Y").otherwise("").alias("RCM"))


def _order_totals(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_totalprice").cast(MONEY).alias("price"), F.col("o_orderdate").cast("date").alias("day"))
    cust = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("ledger_id"))
    return orders.join(cust, orders.o_custkey == cust.c_custkey).groupBy("ledger_id", *extra).agg(
        F.sum("price").alias("p"))


def gstr3b_wide_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row per ledger and month, a column per figure."""
    m = _order_totals(spark, sf_dir, F.date_format("day", "MM").alias("mm"), F.year("day").alias("yy"))
    part = lambda f: _text(F.col("p") * F.lit(f).cast("decimal(6,4)"))
    return m.select(
        "ledger_id", F.concat_ws("-", "ledger_id", "yy", "mm").alias("doc_id"),
        F.when(F.col("yy") % 2 == 0, F.concat_ws("/", "mm", F.col("yy").cast("string")))
        .otherwise(F.concat("mm", F.col("yy").cast("string"))).alias("Return Period"),
        part("1").alias("Taxable Value"), part("0.18").alias("Integrated Tax"), F.lit("0").alias("CGST"),
        part("0.05").alias("ITC IGST"), F.lit("").alias("ITC CGST"), part("0.13").alias("Payable IGST"),
        part("0.12").alias("Cash IGST"))


# fixed values: labels of the label/value layout with their share of turnover
LABELS = [("3.1 Outward Taxable supplies", "1"), ("3.1 IGST", "0.18"), ("4 ITC IGST", "0.05"),
          ("6 Payable IGST", "0.13"), ("6 Paid IGST", "0.12")]


def gstr3b_label_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per figure: (label, amount)."""
    m = _order_totals(spark, sf_dir, F.year("day").alias("yy"))
    pairs = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).cast("decimal(6,4)").alias("share")) for a, b in LABELS])
    return m.select("ledger_id", F.concat_ws("-", "ledger_id", "yy").alias("doc_id"), "p", F.explode(pairs).alias("x")).select(
        "ledger_id", "doc_id", F.col("x.label").alias("Description"), _text(F.col("p") * F.col("x.share")).alias("Amount"))


def itr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income-tax return rows: one document per ledger and year, one row per quarter."""
    m = _order_totals(spark, sf_dir, F.year("day").alias("yy"), F.quarter("day").alias("q"))
    blank_first = (F.col("ledger_id") % 3 == 0) & (F.col("q") == 1)
    part = lambda f: _text(F.col("p") * F.lit(f).cast("decimal(6,4)"))
    return m.select(
        "ledger_id", F.concat_ws("-", "ledger_id", "yy").alias("doc_id"), F.col("q").alias("row_index"),
        F.concat(F.lit("AY "), F.col("yy").cast("string")).alias("Assessment Year"),
        F.when(blank_first, "0").otherwise(part("1")).alias("Gross Total Income"),
        F.when(F.col("ledger_id") % 4 == 1, "").otherwise(part("0.9")).alias("Taxable Income"),
        part("0.3").alias("Tax Payable"),
        F.when(F.col("ledger_id") % 2 == 0, part("0.35")).otherwise("").alias("Tax Paid"),
        part("0.2").alias("Advance Tax"), F.lit("2002-07-31").alias("Filed On"))


def gstr2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase-side invoices as the tax network sees them, already in canonical columns."""
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_extendedprice").cast(MONEY).alias("taxable_value"), F.col("l_shipdate").cast("date").alias("invoice_date"))
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    k = F.col("l_orderkey")
    return line.filter(k % 29 != 3).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("ledger_id"), F.col("s_name").alias("supplier_name"),
        F.concat(F.lit("PUR-"), F.concat_ws("-", k, "l_linenumber", "l_partkey", "l_suppkey")).alias("invoice_no"),
        "invoice_date", "taxable_value", (k % 31 != 4).alias("itc_eligible"))
