"""Ledger against tax documents: totals, invoice and party matching, gaps as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import effective_amount, keyword_any, natural_order, total_if
from ..functions.names import fuzzy_pairs, name_similarity

L = "ledger_id"
GAP = [L, "code", "severity", "party", "reference", "gl_amount", "doc_amount", "variance"]

# fixed values: keyword lists
TDS_WORDS = ["tds", "tax deducted", "tax deduction", "tax at source", "194c", "194j", "194h", "194a", "194i",
             "194q", "206c"]
SALES_WORDS = ["sales", "revenue", "income", "turnover", "sale", "outward supply", "gst sales", "tax invoice"]
SALES_VOUCHERS = ["sales", "sale", "invoice", "tax invoice"]
PURCHASE_WORDS = ["purchase", "inward supply", "purchase invoice", "expense", "gst purchase"]
PURCHASE_VOUCHERS = ["purchase", "purchase invoice", "bill"]
TOLERANCE_26Q, TOLERANCE_GSTR1 = 1, 100
TEXT = ["account_name", "account_group", "description"]


def filter_tds_rows(gl: DataFrame) -> DataFrame:
    return gl.filter(keyword_any([*TEXT, "voucher_type"], TDS_WORDS))


def filter_sales_rows(gl: DataFrame) -> DataFrame:
    return gl.filter(keyword_any(TEXT, SALES_WORDS) | keyword_any(["voucher_type"], SALES_VOUCHERS))


def filter_purchase_rows(gl: DataFrame) -> DataFrame:
    return gl.filter(keyword_any(TEXT, PURCHASE_WORDS) | keyword_any(["voucher_type"], PURCHASE_VOUCHERS))


def _money(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def _gaps(df: DataFrame, code: str | Column, severity: Column, party: Column, reference: Column,
          gl: Column, doc: Column, variance: Column) -> DataFrame:
    none = F.lit(None)
    cols = [party, reference, gl, doc, variance]
    party, reference, gl, doc, variance = [none if c is None else c for c in cols]
    return df.select(
        L, (F.lit(code) if isinstance(code, str) else code).alias("code"), severity.alias("severity"), party.cast("string").alias("party"),
        reference.cast("string").alias("reference"), _money(gl.cast("decimal(38,4)")).alias("gl_amount"),
        _money(doc.cast("decimal(38,4)")).alias("doc_amount"),
        _money(variance.cast("decimal(38,4)")).alias("variance"))


def _totals(gl_rows: DataFrame, amount: Column, docs: DataFrame, doc_amount: str) -> DataFrame:
    """Both totals per ledger in one grouping of a union (a ledger may miss either side)."""
    a = gl_rows.select(L, amount.cast("decimal(38,4)").alias("g"), F.lit(0).cast("decimal(38,4)").alias("d"))
    b = docs.select(L, F.lit(0).cast("decimal(38,4)").alias("g"), F.col(doc_amount).cast("decimal(38,4)").alias("d"))
    return a.unionByName(b).groupBy(L).agg(F.sum("g").alias("g"), F.sum("d").alias("d"))


def _overall(totals: DataFrame, code: str, tolerance: int, critical: int) -> DataFrame:
    v = F.abs(F.col("g") - F.col("d"))
    sev = F.when(v > critical, "critical").otherwise("review")
    return _gaps(totals.filter(v > tolerance), code, sev, None, None, F.col("g"), F.col("d"), v)


# --- ledger against 26Q ------------------------------------------------------------


def _gl_party() -> Column:
    return F.coalesce("party_name", "vendor_name", "customer_name", F.lit(""))


def deductees(form: DataFrame) -> DataFrame:
    """Per PAN (else name): the first row's name and PAN, and totals."""
    key = F.when(F.col("deductee_pan") != "", F.col("deductee_pan")).otherwise(F.lower(F.trim("deductee_name")))
    return form.groupBy(L, key.alias("key")).agg(
        F.min_by("deductee_name", natural_order("row_key")).alias("name"), F.min_by("deductee_pan", natural_order("row_key")).alias("pan"),
        F.sum("tds_deducted").alias("deducted"), F.sum("tds_deposited").alias("deposited"))


def party_matches(gl: DataFrame, form: DataFrame) -> DataFrame:
    """Fuzzy pairs (ledger, deductee name, GL party) above one half."""
    parties = filter_tds_rows(gl).select(L, _gl_party().alias("name")).filter(F.col("name") != "").distinct()
    return fuzzy_pairs(deductees(form).select(L, "name"), parties, [L], "name", 0.5)


def gl_26q_gaps(gl: DataFrame, form: DataFrame) -> DataFrame:
    rows = filter_tds_rows(gl)
    overall = _overall(_totals(rows, effective_amount(), form, "tds_deducted"), "GL26Q-001", TOLERANCE_26Q, 10000)
    # the ledger side collapses to one row per party before any matching
    parties = rows.groupBy(L, _gl_party().alias("party")).agg(F.sum(effective_amount()).alias("amount"))
    d = deductees(form)
    pairs = fuzzy_pairs(d.select(L, "name"), parties.filter("party <> ''").select(L, F.col("party").alias("name")),
                        [L], "name", 0.5)
    per_name = (pairs.join(parties.withColumnRenamed("party", "right_name"), [L, "right_name"])
                .groupBy(L, F.col("left_name").alias("name")).agg(F.sum("amount").alias("gl_amount")))
    matched = d.join(per_name, [L, "name"], "left")
    pan = F.when(F.col("pan") != "", F.col("pan"))
    # one branch for both: no ledger counterpart, or one that differs
    v = F.coalesce(F.abs(F.col("gl_amount") - F.col("deducted")), F.col("deducted"))
    absent = F.col("gl_amount").isNull()
    per_party = _gaps(
        matched.filter(absent | (v > TOLERANCE_26Q)), F.when(absent, "GL26Q-002").otherwise("GL26Q-003"),
        F.when(~absent & (v > 5000), "critical").otherwise("review"), F.col("name"), pan, F.col("gl_amount"),
        F.col("deducted"), v)
    seen = pairs.select(L, F.col("right_name").alias("party")).distinct()
    stray = rows.withColumn("party", _gl_party()).filter("party <> ''").join(seen, [L, "party"], "left_anti")
    unmatched = _gaps(stray, "GL26Q-004", F.lit("info"), F.col("party"), F.col("reference_number"),
                      effective_amount(), None, effective_amount())
    dep = form.groupBy(L).agg((F.sum("tds_deducted") - F.sum("tds_deposited")).alias("gap"))
    gap = F.col("gap")
    undeposited = _gaps(dep.filter(gap > TOLERANCE_26Q), "GL26Q-005", F.when(gap > 5000, "critical").otherwise("review"),
                        None, None, None, gap, gap)
    return overall.unionByName(per_party).unionByName(unmatched).unionByName(undeposited)


# --- ledger against GSTR-1 -----------------------------------------------------------


def _ref(c: str) -> Column:
    return F.upper(F.trim(c))


def invoices(docs: DataFrame) -> DataFrame:
    return docs.groupBy(L, _ref("invoice_no").alias("ref")).agg(
        F.sum("taxable_value").alias("taxable"), F.min_by(F.coalesce("receiver_name", F.lit("")), natural_order("row_key")).alias("receiver"))


def invoice_anti_both(gl: DataFrame, docs: DataFrame) -> DataFrame:
    """Ledger rows without a return invoice, and return invoices without a ledger row."""
    rows = filter_sales_rows(gl).withColumn("ref", _ref("reference_number")).filter("ref <> ''")
    inv = invoices(docs)
    only_gl = _gaps(rows.join(inv.select(L, "ref"), [L, "ref"], "left_anti"), "G1GL-002", F.lit("review"),
                    F.coalesce("customer_name", "party_name"), F.col("ref"), effective_amount(), None, effective_amount())
    only_doc = _gaps(inv.join(rows.select(L, "ref"), [L, "ref"], "left_anti"), "G1GL-003", F.lit("review"),
                     F.when(F.col("receiver") != "", F.col("receiver")), F.col("ref"), None, F.col("taxable"),
                     F.col("taxable"))
    return only_gl.unionByName(only_doc)


def gl_gstr1_gaps(gl: DataFrame, docs: DataFrame) -> DataFrame:
    rows = filter_sales_rows(gl)
    overall = _overall(_totals(rows, effective_amount(), docs, "taxable_value"), "G1GL-001", TOLERANCE_GSTR1, 50000)
    i, c, s = F.col("igst"), F.col("cgst"), F.col("sgst")
    tv = F.col("taxable_value")
    mixed = (F.col("supply_type") == "B2B") & F.col("receiver_gstin").isNotNull() & (i > 0) & ((c > 0) | (s > 0))
    zero = (tv > 100000) & (i + c + s == 0) & (F.col("supply_type") != "NIL")
    per = docs.groupBy(L).agg(
        F.count_if(mixed).alias("mn"), total_if(mixed, tv).alias("mx"), total_if(mixed, i + c + s).alias("mt"),
        F.count_if(zero).alias("zn"), total_if(zero, tv).alias("zx"))
    both = _gaps(per.filter("mn > 0"), "G1GL-004", F.lit("review"), None, None, None, F.col("mx"), F.col("mt"))
    nil = _gaps(per.filter("zn > 0"), "G1GL-005", F.lit("info"), None, None, None, F.col("zx"), F.lit(0))
    named = rows.withColumn("ref", _ref("reference_number")).withColumn(
        "gl_party", F.coalesce("customer_name", "party_name", F.lit(""))).filter("ref <> '' AND gl_party <> ''")
    pair = named.join(invoices(docs).filter("receiver <> ''"), [L, "ref"]).filter(
        name_similarity(F.col("gl_party"), F.col("receiver")) < 0.4)
    other = _gaps(pair, "G1GL-006", F.lit("info"), F.col("gl_party"), F.col("ref"), effective_amount(), F.col("taxable"),
                  F.lit(0))
    return (overall.unionByName(invoice_anti_both(gl, docs)).unionByName(both).unionByName(nil).unionByName(other))


# --- summaries -----------------------------------------------------------------------


def doc_recon_summary(kind: str, gl: DataFrame, docs: DataFrame) -> DataFrame:
    """Per ledger: both totals, matched and unmatched amounts, gaps by severity.  ``kind`` is 26q or gstr1."""
    if kind == "26q":
        rows, column, gaps = filter_tds_rows(gl), "tds_deducted", gl_26q_gaps(gl, docs)
    else:
        rows, column, gaps = filter_sales_rows(gl), "taxable_value", gl_gstr1_gaps(gl, docs)
    totals = _totals(rows, effective_amount(), docs, column)
    per = gaps.groupBy(L).agg(
        F.sum(F.col("variance").cast("decimal(38,2)")).alias("u"), F.count(F.lit(1)).alias("total_gaps"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "review", "info")])
    g, d = F.col("g"), F.col("d")
    matched = F.greatest(F.lit(0), F.least(g, d) - F.abs(g - d))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return totals.join(per, L, "left").select(
        L, _money(g).alias("gl_total"), _money(d).alias("doc_total"), _money(matched).alias("matched_total"),
        F.coalesce(F.col("u"), F.lit(0)).cast("double").alias("unmatched_total"),
        zero("total_gaps"), zero("critical"), zero("review"), zero("info"))


def vendor_compliance_rollup(purchases: DataFrame, statement: DataFrame) -> DataFrame:
    """Vendor x month: invoices, how many are at risk (credit refused, or absent from the statement), and the amount.

    ``purchases``: (ledger_id, vendor, invoice_no, invoice_date, amount); ``statement``:
    (ledger_id, invoice_no, itc_eligible).
    """
    known = statement.groupBy(L, F.col("invoice_no")).agg(F.bool_and("itc_eligible").alias("ok"))
    risk = ~F.coalesce(F.col("ok"), F.lit(False))
    return purchases.join(known, [L, "invoice_no"], "left").groupBy(
        L, "vendor", F.date_format("invoice_date", "MM-yyyy").alias("period")).agg(
        F.count(F.lit(1)).alias("invoices_total"), F.count_if(risk).alias("invoices_at_risk"),
        _money(total_if(risk, F.col("amount"))).alias("amount_at_risk"))
