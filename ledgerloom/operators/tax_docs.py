"""Tax documents: alias-driven parsing and rule scans, many documents per job."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import natural_order, total_if
from ..sources.schema import MONEY
from .checks import ISSUE, _counted, _stack

L = "ledger_id"

# --- reading foreign headers -----------------------------------------------------


def header_key(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def pick(df: DataFrame, aliases: Sequence[str]) -> Column:
    """First non-blank value among the columns that carry one of ``aliases``, in alias order."""
    by_key = {header_key(c): c for c in df.columns}
    hits = [by_key[header_key(a)] for a in aliases if header_key(a) in by_key]
    cols = [F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`").cast("string")) for c in dict.fromkeys(hits)]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, ",", "").try_cast(MONEY), F.lit(0).cast(MONEY))


def day(c: Column) -> Column:
    """d/m/yyyy or d-m-yyyy, else ISO; NULL when unreadable."""
    s = F.trim(c)
    indian = s.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$")
    return F.when(indian, F.try_to_date(F.regexp_replace(s, "-", "/"), "d/M/yyyy")).otherwise(
        F.substring(s, 1, 10).try_cast("date"))


# fixed values: header aliases of the 26Q return
ALIASES_26Q = {
    "deductee_name": ["deductee_name", "party_name", "vendor_name", "name_of_deductee"],
    "deductee_pan": ["deductee_pan", "pan", "pan_of_deductee", "pan_no", "pan_number"],
    "deductee_type": ["deductee_type", "deductee_code", "type_of_deductee"],
    "section": ["tds_section", "section", "section_code", "nature_of_payment_code", "section of act"],
    "nature_of_payment": ["nature_of_payment", "payment_nature", "description", "particulars"],
    "gross_amount": ["gross_amount", "amount_paid", "amount_credited", "payment_amount", "total_amount"],
    "tds_deducted": ["tds_deducted", "tax_deducted", "tds_amount", "deducted_amount"],
    "tds_deposited": ["tds_deposited", "tax_deposited", "deposited_amount", "challan_tds_amount"],
    "bsr_code": ["bsr_code", "bsr", "bank_bsr", "challan_bsr_code", "bsr_of_bank"],
    "challan_date": ["challan_date", "date_of_deposit", "deposit_date"],
    "challan_serial_no": ["challan_serial_no", "challan_serial_number", "challan_no", "serial_no"],
    "challan_amount": ["challan_amount", "challan_total_amount", "total_challan_amount"],
    "date_of_payment": ["date_of_payment", "payment_date", "transaction_date"],
    "date_of_deduction": ["date_of_deduction", "deduction_date"],
    "certificate_no": ["certificate_no", "lower_deduction_certificate", "cert_no"],
    "remarks": ["remarks", "remark", "notes", "note", "comment"],
}

# fixed values: header aliases of the GSTR-1 return
ALIASES_GSTR1 = {
    "invoice_no": ["invoice_no", "invoice_number", "bill_no", "doc_no", "invoice_num", "inv_no"],
    "invoice_date": ["invoice_date", "bill_date", "doc_date", "date"],
    "invoice_value": ["invoice_value", "total_invoice_value", "total_value", "gross_value", "inv_value"],
    "receiver_gstin": ["receiver_gstin", "buyer_gstin", "gstin_of_recipient", "gstin", "customer_gstin", "party_gstin"],
    "receiver_name": ["receiver_name", "buyer_name", "customer_name", "party_name", "recipient_name"],
    "place_of_supply": ["place_of_supply", "pos", "supply_state", "state_code", "state"],
    "taxable_value": ["taxable_value", "assessable_value", "net_amount", "base_amount"],
    "igst": ["igst", "igst_amount", "integrated_tax", "igst_amt"],
    "cgst": ["cgst", "cgst_amount", "central_tax", "cgst_amt"],
    "sgst": ["sgst", "sgst_amount", "state_tax", "sgst_amt", "utgst", "utgst_amount"],
    "cess": ["cess", "cess_amount", "compensation_cess", "cess_amt"],
    "supply_type": ["supply_type", "type", "invoice_type", "transaction_type", "b2b_b2c", "type_of_supply"],
    "hsn_code": ["hsn_code", "hsn", "sac_code", "sac", "hsn_sac", "hsn_sac_code"],
    "reverse_charge": ["reverse_charge", "rcm", "is_reverse_charge", "reverse charge applicable"],
}


def parse_26q(raw: DataFrame) -> DataFrame:
    """Raw rows (ledger_id, row_key, foreign columns...) to canonical 26Q rows."""
    p = {k: pick(raw, v) for k, v in ALIASES_26Q.items()}
    section = text(p["section"])
    deducted = number(p["tds_deducted"])
    deposited = F.when(p["tds_deposited"].isNotNull(), number(p["tds_deposited"])).otherwise(deducted)
    blank_null = lambda c: F.when(text(c) != "", text(c))
    return raw.filter(~F.lower(section).isin("section", "tds_section")).select(
        L, "row_key",
        F.coalesce(blank_null(p["deductee_name"]), F.lit("Unknown")).alias("deductee_name"),
        F.upper(text(p["deductee_pan"])).alias("deductee_pan"),
        F.coalesce(blank_null(p["deductee_type"]), F.lit("P")).alias("deductee_type"),
        F.regexp_replace(F.upper(section), r"\s+", "").alias("section"),
        text(p["nature_of_payment"]).alias("nature_of_payment"),
        number(p["gross_amount"]).alias("gross_amount"), deducted.alias("tds_deducted"),
        deposited.alias("tds_deposited"), F.regexp_replace(text(p["bsr_code"]), r"\s+", "").alias("bsr_code"),
        day(p["challan_date"]).alias("challan_date"), text(p["challan_serial_no"]).alias("challan_serial_no"),
        F.when(p["challan_amount"].isNotNull(), number(p["challan_amount"])).otherwise(deposited).alias("challan_amount"),
        day(p["date_of_payment"]).alias("date_of_payment"), day(p["date_of_deduction"]).alias("date_of_deduction"),
        blank_null(p["certificate_no"]).alias("certificate_no"), blank_null(p["remarks"]).alias("remarks"))


def parse_gstr1(raw: DataFrame) -> DataFrame:
    p = {k: pick(raw, v) for k, v in ALIASES_GSTR1.items()}
    invoice, gstin, kind = text(p["invoice_no"]), text(p["receiver_gstin"]), text(p["supply_type"])
    return raw.filter((invoice != "") & ~F.lower(invoice).isin("invoice_no", "invoice no")).select(
        L, "row_key", invoice.alias("invoice_no"), day(p["invoice_date"]).alias("invoice_date"),
        number(p["invoice_value"]).alias("invoice_value"), F.when(gstin != "", gstin).alias("receiver_gstin"),
        F.when(text(p["receiver_name"]) != "", text(p["receiver_name"])).alias("receiver_name"),
        text(p["place_of_supply"]).alias("place_of_supply"),
        *[number(p[c]).alias(c) for c in ("taxable_value", "igst", "cgst", "sgst", "cess")],
        F.when(kind != "", F.upper(kind)).when(F.length(gstin) == 15, "B2B").otherwise("B2C").alias("supply_type"),
        F.when(text(p["hsn_code"]) != "", text(p["hsn_code"])).alias("hsn_code"),
        F.lower(text(p["reverse_charge"])).isin("y", "yes", "true", "1").alias("reverse_charge"))


# fixed values: header aliases of the GSTR-3B summary; matched as headers, or inside a label
ALIASES_3B = {
    "outward_taxable_value": ["taxable_value", "outward_taxable_value", "total_taxable_value",
                              "3.1 outward taxable", "outward supplies"],
    "outward_igst": ["igst", "integrated_tax", "outward_igst", "3.1 igst"],
    "outward_cgst": ["cgst", "central_tax", "outward_cgst", "3.1 cgst"],
    "outward_sgst": ["sgst", "state_tax", "outward_sgst", "3.1 sgst", "utgst"],
    "itc_igst": ["itc_igst", "input_igst", "eligible_itc_igst", "4 itc igst"],
    "itc_cgst": ["itc_cgst", "input_cgst", "eligible_itc_cgst", "4 itc cgst"],
    "itc_sgst": ["itc_sgst", "input_sgst", "eligible_itc_sgst", "4 itc sgst", "utgst_itc"],
    "payable_igst": ["tax_payable_igst", "payable_igst", "6 payable igst"],
    "payable_cgst": ["tax_payable_cgst", "payable_cgst", "6 payable cgst"],
    "payable_sgst": ["tax_payable_sgst", "payable_sgst", "6 payable sgst"],
    "paid_igst": ["tax_paid_igst", "paid_igst", "6 paid igst", "cash_igst"],
    "paid_cgst": ["tax_paid_cgst", "paid_cgst", "6 paid cgst", "cash_cgst"],
    "paid_sgst": ["tax_paid_sgst", "paid_sgst", "6 paid sgst", "cash_sgst"],
}


def _summary_out(sums: DataFrame) -> DataFrame:
    some = F.lit(False)
    for f in ALIASES_3B:
        some = some | (F.col(f) != 0)
    return sums.filter(some).select(L, "doc_id", "period", *[F.col(f).cast("double").alias(f) for f in ALIASES_3B])


def parse_gstr3b(raw: DataFrame) -> DataFrame:
    """Either layout: a column per figure, or (label, amount) rows; a document without figures is dropped."""
    own = [c for c in raw.columns if c not in (L, "doc_id")]
    labels = [c for c in own if re.search(r"label|field|description|name", c, re.I)]
    period = F.lit(None).cast("string")
    for c in own:
        if re.search(r"period|month|return_period", c, re.I):
            v = F.trim(F.col(f"`{c}`"))
            period = F.coalesce(period, F.when(v.rlike(r"^\d{2}[/-]\d{4}$"), F.regexp_replace(v, "/", "-"))
                                .when(v.rlike(r"^\d{6}$"), F.concat_ws("-", F.substring(v, 1, 2), F.substring(v, 3, 4))))
    keys = {header_key(c) for c in own}
    sums = []
    for f, aliases in ALIASES_3B.items():
        named = [a for a in aliases if header_key(a) in keys]
        if named:
            value = number(pick(raw, named[:1]))
        elif labels:
            label = F.lower(F.trim(F.coalesce(F.col(f"`{labels[0]}`"), F.lit(""))))
            amount = next(c for c in own if c != labels[0])
            hit = F.lit(False)
            for a in aliases:
                hit = hit | label.contains(a)
            value = F.when(hit, number(F.col(f"`{amount}`").cast("string"))).otherwise(F.lit(0))
        else:
            value = F.lit(0)
        sums.append(F.sum(value).alias(f))
    return _summary_out(raw.groupBy(L, "doc_id").agg(F.coalesce(F.max(period), F.lit("")).alias("period"), *sums))


# fixed values: header aliases of the income-tax return
ALIASES_ITR = {
    "gross_total_income": ["gross_total_income", "total_income_before_deduction", "income_before_deduction", "part_b_gti"],
    "taxable_income": ["taxable_income", "total_income", "net_income", "income_chargeable_to_tax"],
    "tax_payable": ["tax_payable", "total_tax_payable", "tax_on_total_income", "net_tax_payable"],
    "tax_paid": ["tax_paid", "advance_tax", "tds_amount", "tax_already_paid", "taxes_paid"],
    "refund_due": ["refund_due", "refund_amount", "tax_refundable", "excess_tax_paid"],
}


def parse_itr(raw: DataFrame) -> DataFrame:
    """First non-zero figure per field in row order; a document without income is dropped."""
    by_key = {header_key(c): c for c in raw.columns}

    def first(aliases: list[str], numeric: bool) -> Column:
        cols = [F.col(f"`{by_key[a]}`") for a in aliases if a in by_key]
        vals = [F.nullif(number(c), F.lit(0)) if numeric else F.when(F.trim(c) != "", F.trim(c)) for c in cols]
        here = F.coalesce(*vals) if vals else F.lit(None).cast(MONEY if numeric else "string")
        return F.min_by(here, F.when(here.isNotNull(), F.col("row_index")))

    agg = raw.groupBy(L, "doc_id").agg(
        *[F.coalesce(first(a, True), F.lit(0).cast(MONEY)).alias(f) for f, a in ALIASES_ITR.items()],
        F.coalesce(first(["assessment_year", "ay", "a_y"], False), F.lit("")).alias("assessment_year"),
        F.coalesce(first(["itr_form", "form_type", "itr_type"], False), F.lit("ITR")).alias("itr_form"),
        first(["filing_date", "date_of_filing", "acknowledgement_date", "filed_on"], False).alias("filed"))
    dbl = lambda c, n: c.cast("double").alias(n)
    income = F.when(F.col("taxable_income") != 0, F.col("taxable_income")).otherwise(F.col("gross_total_income"))
    refund = F.when(F.col("refund_due") != 0, F.col("refund_due")).otherwise(
        F.greatest(F.lit(0), F.col("tax_paid") - F.col("tax_payable")))
    return agg.filter((F.col("gross_total_income") != 0) | (F.col("taxable_income") != 0)).select(
        L, "doc_id", "assessment_year", "itr_form", dbl(F.col("gross_total_income"), "gross_total_income"),
        dbl(income, "taxable_income"), dbl(F.col("tax_payable"), "tax_payable"), dbl(F.col("tax_paid"), "tax_paid"),
        dbl(refund, "refund_due"), day(F.col("filed")).alias("filing_date"))


# --- 26Q -------------------------------------------------------------------------

# fixed values: TDS sections -> (threshold, company rate, individual rate); rate 0 = variable
TDS_SECTIONS = {
    "192": (250000, "0", "0"), "193": (10000, "0.10", "0.10"), "194": (5000, "0.10", "0.10"),
    "194A": (40000, "0.10", "0.10"), "194C": (30000, "0.02", "0.01"), "194D": (15000, "0.10", "0.05"),
    "194G": (15000, "0.05", "0.05"), "194H": (15000, "0.05", "0.05"), "194I": (240000, "0.10", "0.10"),
    "194IA": (5000000, "0.01", "0.01"), "194J": (30000, "0.10", "0.10"), "194K": (5000, "0.10", "0.10"),
    "194LA": (250000, "0.10", "0.10"), "194Q": (5000000, "0.001", "0.001"), "206C": (0, "0.01", "0.01"),
}
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
RATE = "decimal(6,4)"


def _section_value(section: Column, index: int, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for code, row in TDS_SECTIONS.items():
        out = F.when(section == code, F.lit(str(row[index])).cast(kind)).otherwise(out)
    return out


def with_tds_section(rows: DataFrame) -> DataFrame:
    """Add ``threshold`` and ``expected_rate`` (NULL for an unknown section)."""
    code = F.upper(F.regexp_replace(F.regexp_replace("section", r"\s+", ""), r"(?i)^sec\.?", ""))
    company = F.col("deductee_type").rlike(r"(?i)^c|company|pvt|ltd|llp")
    return rows.withColumn("threshold", _section_value(code, 0, "decimal(20,4)")).withColumn(
        "expected_rate", F.when(company, _section_value(code, 1, RATE)).otherwise(_section_value(code, 2, RATE)))


def summary_26q(rows: DataFrame) -> DataFrame:
    challan = F.concat_ws("-", "bsr_code", "challan_serial_no")
    when_paid = F.coalesce("date_of_payment", "challan_date")
    m = lambda c, n: F.round(c, 2).cast("double").alias(n)
    return rows.groupBy(L).agg(
        F.count(F.lit(1)).alias("total_rows"), m(F.sum("gross_amount"), "total_gross"),
        m(F.sum("tds_deducted"), "total_deducted"), m(F.sum("tds_deposited"), "total_deposited"),
        m(F.sum(F.col("tds_deducted") - F.col("tds_deposited")), "gap"),
        F.count_distinct("deductee_pan").alias("deductees"),
        F.count_distinct(F.when(F.col("section") != "", F.col("section"))).alias("sections"),
        F.count_distinct(F.when(challan != "-", challan)).alias("challans"),
        F.min(when_paid).alias("period_start"), F.max(when_paid).alias("period_end"))


def _rows_26q(rows: DataFrame) -> DataFrame:
    g, d, rate = F.col("gross_amount"), F.col("tds_deducted"), F.col("expected_rate")
    checked = (g > 0) & (rate != 0) & F.col("certificate_no").isNull()
    low = checked & (d > 0) & (d < (rate - F.lit("0.005").cast(RATE)) * g)
    none = checked & (d == 0) & (g >= F.col("threshold"))
    f = with_tds_section(rows)
    return (f.withColumn("bad_pan", (F.col("deductee_pan") != "") & ~F.col("deductee_pan").rlike(PAN))
            .withColumn("no_pan", F.col("deductee_pan").isin("", "PANNOTAVBL", "PANINVALID"))
            .withColumn("bad_bsr", (F.col("bsr_code") != "") & ~F.col("bsr_code").rlike(r"^\d{7}$"))
            .withColumn("odd_section", (F.col("section") != "") & F.col("threshold").isNull())
            .withColumn("rate_off", F.coalesce(low | none, F.lit(False)))
            .withColumn("no_challan", (d > 0) & ((F.col("bsr_code") == "") | (F.col("challan_serial_no") == "")
                                                 | F.col("challan_date").isNull())))


def deposit_gaps(rows: DataFrame) -> DataFrame:
    """Challans whose deductions differ from the deposit stated on their last row by over 1."""
    per = rows.groupBy(L, "bsr_code", "challan_date", "challan_serial_no").agg(
        F.sum("tds_deducted").alias("deducted"), F.max_by("tds_deposited", natural_order("row_key")).alias("deposited"),
        F.count(F.lit(1)).alias("n"))
    gap = F.abs(F.col("deducted") - F.col("deposited"))
    return per.filter((F.col("deposited") > 0) & (gap > 1)).withColumn("gap", gap)


CODES_26Q = ["26Q-PAN-001", "26Q-PAN-002", "26Q-BSR-001", "26Q-SEC-001", "26Q-RATE-001", "26Q-DEP-001", "26Q-CHN-001"]


def issues_26q(rows: DataFrame, codes: Sequence[str] = tuple(CODES_26Q)) -> DataFrame:
    """All row rules in one pass; the challan rule in one grouped pass of its own."""
    g, d = F.col("gross_amount"), F.col("tds_deducted")
    short = F.greatest(F.lit(0), g * F.coalesce("expected_rate", F.lit(0)) - d)
    rules = {
        "26Q-PAN-001": ("bad_pan", d, "critical", "PAN Validation", "deductee PAN invalid format", "deductee PANs invalid format"),
        "26Q-PAN-002": ("no_pan", g * F.lit("0.20").cast(RATE) - d, "review", "PAN Validation",
                        "deductee missing or invalid PAN", "deductees missing or invalid PAN"),
        "26Q-BSR-001": ("bad_bsr", F.col("tds_deposited"), "critical", "Challan Validation",
                        "challan with invalid BSR code", "challans with invalid BSR code"),
        "26Q-SEC-001": ("odd_section", None, "review", "Section Validation",
                        "entry with unrecognised TDS section", "entries with unrecognised TDS section"),
        "26Q-RATE-001": ("rate_off", short, "review", "TDS Rate Check",
                         "entry with lower-than-expected TDS rate", "entries with lower-than-expected TDS rate"),
        "26Q-CHN-001": ("no_challan", d, "review", "Challan Validation",
                        "TDS entry missing challan details", "TDS entries missing challan details"),
    }
    parts = []
    wanted = [c for c in codes if c in rules]
    if wanted:
        agg = _rows_26q(rows).groupBy(L).agg(*[
            c for code in wanted for c in (
                F.count_if(rules[code][0]).alias(f"{code}_n"),
                (total_if(F.col(rules[code][0]), rules[code][1]) if rules[code][1] is not None else F.max(F.lit(None).cast(MONEY)))
                .alias(f"{code}_x"))])
        parts.append(_stack(agg, [
            (F.col(f"`{c}_n`") > 0, c, F.lit(rules[c][2]), rules[c][3], _counted(F.col(f"`{c}_n`"), *rules[c][4:]),
             F.col(f"`{c}_n`"), F.col(f"`{c}_x`"), F.lit(None)) for c in wanted]))
    if "26Q-DEP-001" in codes:
        gaps = deposit_gaps(rows).groupBy(L).agg(F.sum("n").alias("n"), F.sum("gap").alias("x"))
        parts.append(_stack(gaps, [(F.col("n") > 0, "26Q-DEP-001", F.lit("critical"), "Deducted vs Deposited",
                                    F.lit("Gap between TDS deducted and deposited"), F.col("n"), F.col("x"), F.lit(None))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*ISSUE)


# --- GSTR-1 ----------------------------------------------------------------------

GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$"
# fixed values: state codes 01..37, 97, 99; standard GST rates; default supplier state
STATE_CODES = [f"{i:02d}" for i in range(1, 38)] + ["97", "99"]
GST_RATES = [0.0, 0.05, 0.12, 0.18, 0.28]
DEFAULT_STATE = "27"
CODES_GSTR1 = ["G1-GSTIN-001", "G1-POS-001", "G1-TAX-001", "G1-TAX-002", "G1-DUP-001", "G1-HSN-001"]


def _rows_gstr1(rows: DataFrame, supplier_state: str) -> DataFrame:
    pos = F.substring(F.trim("place_of_supply"), 1, 2)
    has_i, has_cs = F.col("igst") > 0, (F.col("cgst") > 0) | (F.col("sgst") > 0)
    intra = pos == supplier_state
    tax = F.col("igst") + F.col("cgst") + F.col("sgst")
    rate = F.try_divide(tax.cast("double"), F.col("taxable_value").cast("double"))
    off = F.array_min(F.transform(F.array(*[F.lit(r) for r in GST_RATES]), lambda r: F.abs(r - rate)))
    return (rows.withColumn("tax", tax)
            .withColumn("bad_gstin", F.coalesce(~F.upper(F.trim("receiver_gstin")).rlike(GSTIN), F.lit(False)))
            .withColumn("bad_pos", ~pos.isin(STATE_CODES))
            .withColumn("bad_split", ~F.col("reverse_charge") & (F.col("supply_type") != "EXPORT")
                        & ((intra & has_i & ~has_cs) | (~intra & ~has_i & has_cs)))
            .withColumn("bad_rate", (F.col("taxable_value") > 0) & (tax > 100) & (off > 0.005))
            .withColumn("no_hsn", (F.col("invoice_value") >= 50000) & F.col("hsn_code").isNull()))


def issues_gstr1(rows: DataFrame, codes: Sequence[str] = tuple(CODES_GSTR1), supplier_state: str = DEFAULT_STATE) -> DataFrame:
    rules = {
        "G1-GSTIN-001": ("bad_gstin", "invoice_value", "critical", "GSTIN Validation", "invoice with invalid receiver GSTIN",
                         "invoices with invalid receiver GSTIN"),
        "G1-POS-001": ("bad_pos", None, "review", "Place of Supply", "invoice with invalid place of supply code",
                       "invoices with invalid place of supply code"),
        "G1-TAX-001": ("bad_split", "tax", "critical", "Tax Split", "invoice with incorrect IGST/CGST+SGST split",
                       "invoices with incorrect IGST/CGST+SGST split"),
        "G1-TAX-002": ("bad_rate", "taxable_value", "review", "Tax Calculation", "invoice with unexpected tax amount",
                       "invoices with unexpected tax amount"),
        "G1-HSN-001": ("no_hsn", None, "info", "HSN/SAC Code", "invoice above ₹50K missing HSN/SAC code",
                       "invoices above ₹50K missing HSN/SAC code"),
    }
    parts = []
    wanted = [c for c in codes if c in rules]
    if wanted:
        agg = _rows_gstr1(rows, supplier_state).groupBy(L).agg(*[
            c for code in wanted for c in (
                F.count_if(rules[code][0]).alias(f"{code}_n"),
                (total_if(F.col(rules[code][0]), F.col(rules[code][1])) if rules[code][1] else F.max(F.lit(None).cast(MONEY)))
                .alias(f"{code}_x"))])
        parts.append(_stack(agg, [
            (F.col(f"`{c}_n`") > 0, c, F.lit(rules[c][2]), rules[c][3], _counted(F.col(f"`{c}_n`"), *rules[c][4:]),
             F.col(f"`{c}_n`"), F.col(f"`{c}_x`"), F.lit(None)) for c in wanted]))
    if "G1-DUP-001" in codes:
        # group first, so a repeated number travels as one partial count per task
        per = rows.groupBy(L, F.lower(F.trim("invoice_no")).alias("invoice")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("invoice_value").alias("x")).filter("n > 1")
        agg = per.groupBy(L).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("x").alias("x"))
        parts.append(_stack(agg, [(
            F.col("n") > 0, "G1-DUP-001", F.lit("critical"), "Duplicate Invoices",
            _counted(F.col("groups"), "duplicate invoice number found", "duplicate invoice numbers found"),
            F.col("n"), F.col("x"), F.lit(None))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*ISSUE)
