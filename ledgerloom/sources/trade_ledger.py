"""Derive a double-entry GL from the star-schema tables (orders, lineitem, ...).

Each trade row becomes a few vouchers and each voucher a few legs.  The legs
come from exploding a small array of leg codes, so each fact table is scanned
once, unused columns are pruned down to the parquet scan, and date / ledger
filters travel below the explode.  Hundreds mark the voucher, units the leg.
Trade rows, narrow and few, are put in order of their day before legs are made
of them, in tasks of a bounded number of rows; the wide legs are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schema import MONEY, conform
from .staging import spread

# fixed values: reporting dates used with the derived ledger
AS_OF = "2001-08-02"
PERIOD = ("2001-04-01", "2001-06-30")

# fixed values: journal accounts by l_orderkey mod 14 -> (account, group); the last adds the year
JOURNAL_ACCOUNTS = [
    ("Salary", "Indirect Expenses"),
    ("Office Rent", None),
    ("Depreciation", "Indirect Expenses"),
    ("Term Loan", "Loans (Liability)"),
    ("Plant & Machinery", "Fixed Assets"),
    ("Suspense A/c", "Suspense A/c"),
    ("Prepaid Insurance", "Current Assets"),
    ("Share Capital", "Capital Account"),
    ("Audit Fees Accrued", "Current Liabilities"),
    ("Stock in Hand", "Stock-in-Hand"),
    ("Petty Cash", "Cash-in-Hand"),
    ("Provision for Bad Debts", "Provisions"),
    ("Supplier Advances", "Sundry Creditors"),
    ("Export Debtors", "Sundry Debtors"),
]

# fixed values: narrations by o_orderkey mod 43 (anything else: plain invoice text)
SALES_NARRATIONS = [
    "Advance received against order",
    "Provision for sales returns",
    "Bad debt written off",
    "Intercompany recharge",
    "Exchange gain on settlement",
    "Cash deposited in bank",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: list, default: Column) -> Column:
    out = default
    for i, v in reversed(list(enumerate(values))):
        out = F.when(key == i, F.lit(v)).otherwise(out)
    return out


def _leg(*codes: int) -> Column:
    return F.col("leg").isin(*codes)


def sales_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_totalprice").cast(MONEY).alias("price"),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    customer = read(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    key = F.col("o_orderkey")
    codes = F.concat(
        F.array(*[F.lit(c) for c in (101, 102, 103, 104)]),
        F.when(key % 83 == 2, F.array(*[F.lit(c) for c in (201, 202, 203, 204)]))
        .otherwise(F.array().cast("array<int>")),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit(301), F.lit(302)))
        .otherwise(F.array().cast("array<int>")),
    )
    legs = (
        spread(orders, "o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .sortWithinPartitions("day")
        .withColumn("leg", F.explode(codes))
        .withColumn("kind", F.floor(F.col("leg") / 100).cast("int"))
        .withColumn("pos", F.col("leg") % 100)
    )
    sale = F.col("kind") < 3
    zero = sale & (key % 73 == 4)
    tax = F.round(F.col("price") * F.lit("0.09").cast("decimal(4,2)"), 2).cast(MONEY)
    debtor = (F.col("price") + 2 * tax + F.when(key % 97 == 0, 50).otherwise(0)).cast(MONEY)
    cgst = F.when(
        key % 89 == 1, F.round(tax * F.lit("1.07").cast("decimal(4,2)"), 2).cast(MONEY)
    ).otherwise(tax)
    nil = F.lit(0).cast(MONEY)
    wrong_side = key % 113 == 17
    bare = sale & (key % 107 == 11)
    debit = (
        F.when(sale & (F.col("pos") == 1), debtor)
        .when(sale & (F.col("pos") == 4) & wrong_side, tax)
        .when(_leg(301), F.col("price")).otherwise(nil)
    )
    credit = (
        F.when(sale & (F.col("pos") == 2), F.col("price"))
        .when(sale & (F.col("pos") == 3), cgst)
        .when(sale & (F.col("pos") == 4) & ~wrong_side, tax)
        .when(_leg(302), (F.col("price") - F.when(key % 109 == 13, 10).otherwise(0)).cast(MONEY))
        .otherwise(nil)
    )
    is_debtor = (sale & (F.col("pos") == 1)) | _leg(302)
    ref = (
        F.when(F.col("kind") == 1, F.concat(F.lit("INV-"), key))
        .when(F.col("kind") == 2, F.concat(F.lit("INV-"), key, F.lit("-DUP")))
        .otherwise(F.concat(F.lit("BR-"), key))
    )
    plain = F.concat(F.lit("Invoice to "), F.col("c_name"))
    return legs.select(
        F.col("c_nationkey").alias("ledger_id"),
        F.concat(ref, F.lit("/"), F.col("pos").cast("string")).alias("row_id"),
        F.when(sale & (key % 79 == 3), F.lit(None).cast("date"))
        .otherwise(F.date_add("day", F.when(F.col("kind") == 1, 0).when(F.col("kind") == 2, 3).otherwise(30)))
        .alias("transaction_date"),
        F.when(is_debtor, "Sundry Debtors")
        .when(sale & (F.col("pos") == 2), F.concat(F.lit("Sales - "), "c_mktsegment"))
        .when(bare & (F.col("pos") > 2), "Freight Outward")
        .when(sale & (F.col("pos") == 3), "CGST Output @9%")
        .when(sale & (F.col("pos") == 4), "SGST Output @9%")
        .otherwise("HDFC Bank A/c").alias("account_name"),
        F.when(is_debtor, "Sundry Debtors")
        .when(sale & (F.col("pos") == 2), "Sales Accounts")
        .when(bare, "Indirect Expenses")
        .when(sale, "Duties & Taxes")
        .otherwise("Bank Accounts").alias("account_group"),
        F.when(is_debtor & ~(key % 103 == 5), F.col("c_name")).alias("customer_name"),
        F.when(is_debtor & ~(key % 103 == 5), F.col("c_name")).alias("party_name"),
        F.when(sale | (key % 43 == 5), _pick(key % 43, SALES_NARRATIONS, plain))
        .otherwise("Receipt from customer").alias("description"),
        ref.alias("reference_number"),
        F.when(sale, "Sales").otherwise("Receipt").alias("voucher_type"),
        F.when(sale, F.col("o_orderpriority")).alias("cost_centre"),
        F.when(sale, F.when(F.col("c_mktsegment") == "MACHINERY", "USD").otherwise("INR"))
        .alias("currency_code"),
        F.when(zero, nil).otherwise(debit).alias("debit_amount"),
        F.when(zero, nil).otherwise(credit).alias("credit_amount"),
        (F.when(zero, nil).otherwise(debit) - F.when(zero, nil).otherwise(credit))
        .cast(MONEY).alias("net_amount"),
        (sale & (key % 67 == 6)).alias("excluded"),
    )


def purchase_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
        F.col("l_extendedprice").cast(MONEY).alias("ext"),
        F.col("l_shipdate").cast("date").alias("day"),
    )
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    key = F.col("l_orderkey")
    none = F.array().cast("array<int>")
    deducts = F.col("l_suppkey") % 3 == 0
    codes = F.concat(
        F.array(*[F.lit(c) for c in (101, 102, 103, 104)]),
        F.when(F.col("l_returnflag") == "R",
               F.when(deducts, F.array(F.lit(201), F.lit(202), F.lit(203)))
               .otherwise(F.array(F.lit(201), F.lit(202)))).otherwise(none),
        F.when(F.col("l_linenumber") >= 6, F.array(F.lit(301), F.lit(302))).otherwise(none),
    )
    legs = (
        spread(line, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .sortWithinPartitions("day")
        .withColumn("leg", F.explode(codes))
        .withColumn("kind", F.floor(F.col("leg") / 100).cast("int"))
        .withColumn("pos", F.col("leg") % 100)
    )
    tax = F.round(F.col("ext") * F.lit("0.09").cast("decimal(4,2)"), 2).cast(MONEY)
    tds = F.when(deducts, F.round(F.col("ext") * F.lit("0.02").cast("decimal(4,2)"), 2)).otherwise(0).cast(MONEY)
    nil = F.lit(0).cast(MONEY)
    debit = (
        F.when(_leg(101, 201, 301), F.col("ext")).when(_leg(102, 103), tax).otherwise(nil)
    )
    credit = (
        F.when(_leg(104), (F.col("ext") + 2 * tax).cast(MONEY))
        .when(_leg(202), (F.col("ext") - tds).cast(MONEY))
        .when(_leg(203), tds)
        .when(_leg(302), F.col("ext"))
        .otherwise(nil)
    )
    tail = F.concat_ws("-", key, "l_linenumber", "l_partkey", "l_suppkey")
    prefix = F.when(F.col("kind") == 1, "PUR-").when(F.col("kind") == 2, "BP-").otherwise("JV-")
    ref = F.concat(prefix, tail)
    bank = F.when((F.col("l_linestatus") == "O") | (F.col("kind") == 3), "HDFC Bank A/c").otherwise("ICICI Bank A/c")
    has_party = (_leg(104, 201) & ~(key % 101 == 7)) | _leg(203)
    vendor = F.when(has_party, F.col("s_name"))
    slot = key % 14
    journal = _pick(slot, [a for a, _ in JOURNAL_ACCOUNTS], F.lit(None))
    journal = F.when(slot == 13, F.concat(journal, F.lit(" "), F.year("day").cast("string"))).otherwise(journal)
    return legs.select(
        F.col("s_nationkey").alias("ledger_id"),
        F.concat(ref, F.lit("/"), F.col("pos").cast("string")).alias("row_id"),
        F.date_add("day", F.when(F.col("kind") == 2, 45).otherwise(0)).alias("transaction_date"),
        F.when(F.col("kind") == 1, F.date_add("day", 30)).alias("due_date"),
        F.when(_leg(101), F.concat(F.lit("Purchase - "), "p_brand"))
        .when(_leg(102), "CGST Input @9%").when(_leg(103), "SGST Input @9%")
        .when(_leg(104, 201), "Sundry Creditors").when(_leg(203), "TDS Payable")
        .when(_leg(301), journal)
        .otherwise(bank).alias("account_name"),
        F.when(_leg(101), "Purchase Accounts").when(_leg(102, 103, 203), "Duties & Taxes")
        .when(_leg(104, 201), "Sundry Creditors")
        .when(_leg(301), _pick(slot, [g for _, g in JOURNAL_ACCOUNTS], F.lit(None)))
        .otherwise("Bank Accounts").alias("account_group"),
        vendor.alias("vendor_name"),
        vendor.alias("party_name"),
        F.when(F.col("kind") == 1, "Goods purchased").when(F.col("kind") == 2, "Payment to supplier")
        .otherwise("Journal adjustment").alias("description"),
        ref.alias("reference_number"),
        F.when(F.col("kind") == 1, "Purchase").when(F.col("kind") == 2, "Payment").otherwise("Journal")
        .alias("voucher_type"),
        F.when(F.col("kind") == 1, F.col("p_type")).alias("cost_centre"),
        F.when(F.col("kind") == 1, "INR").alias("currency_code"),
        debit.alias("debit_amount"),
        credit.alias("credit_amount"),
        (debit - credit).cast(MONEY).alias("net_amount"),
        F.when(_leg(301) & (slot == 9), F.col("ext")).when(_leg(301) & (slot == 10), nil)
        .alias("closing_balance"),
        F.lit(False).alias("excluded"),
    )


def gl_with_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, the ones a user has marked as noise included."""
    return conform(sales_side(spark, sf_dir)).unionByName(conform(purchase_side(spark, sf_dir)))


def account_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved account mappings: one confirmed override and one proposal per ledger."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ledger_id"))
    even = F.col("ledger_id") % 2 == 0
    confirmed = nation.select(
        "ledger_id",
        F.when(even, "Suspense A/c").otherwise("Term Loan").alias("account_name"),
        F.when(even, "CURRENT_ASSET").otherwise("CURRENT_LIABILITY").alias("account_type"),
        F.lit(0.95).alias("confidence"), F.lit(True).alias("is_confirmed"))
    proposed = nation.select(
        "ledger_id", F.lit("Office Rent").alias("account_name"), F.lit("COGS").alias("account_type"),
        F.lit(0.75).alias("confidence"), F.lit(False).alias("is_confirmed"))
    return confirmed.unionByName(proposed)
