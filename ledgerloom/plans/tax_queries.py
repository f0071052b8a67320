"""Named queries for tax documents and their reconciliation with the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import doc_recon as D
from ..operators import tax_docs as T
from ..sources import trade_documents as docs
from .check_queries import issue, plural
from ..sources.staging import staged
from .registry import cte, register
from .report_queries import kw, r2

M = "DECIMAL(20,4)"


def _case(values: list[str], cast: str | None = None) -> str:
    whens = " ".join(f"WHEN {i + 1} THEN " + (f"CAST({v} AS {cast})" if cast else f"'{v}'") for i, v in enumerate(values))
    return f"CASE l_linenumber {whens} END"


# numbers in a row key count by value
NATURAL = r"regexp_replace(regexp_replace(row_key, '(\d+)', '" + "0" * 20 + r"\1', 'g'), '\d*(\d{20})', '\1', 'g')"
cte("f0", f"""SELECT s_nationkey AS ledger_id, k || '-' || l_linenumber || '-' || l_partkey || '-' || s AS row_key,
  CASE WHEN s % 4 = 1 THEN s_name || ' Pvt. Ltd' WHEN s % 4 = 2 THEN s_name || ' Traders' ELSE s_name END AS deductee_name,
  CASE WHEN s % 10 = 9 THEN '' WHEN s % 10 = 7 THEN 'ABCD' || lpad(CAST(s % 10000 AS VARCHAR), 4, '0') || 'F'
    ELSE 'ABCDE' || lpad(CAST(s % 10000 AS VARCHAR), 4, '0') || 'F' END AS deductee_pan,
  CASE WHEN s % 2 = 0 THEN 'Company' ELSE 'Individual' END AS deductee_type,
  {_case(docs.SECTION_BY_LINE)} AS section, CAST(ext AS DECIMAL(20,2)) AS gross_amount,
  CAST(CASE WHEN k % 11 = 3 THEN 0 WHEN k % 5 = 0 THEN (CAST(fc AS HUGEINT) + 1) // 2 ELSE CAST(fc AS HUGEINT) END AS DECIMAL(20,2)) / 1 AS dcents,
  k, s, day FROM (SELECT k, l_suppkey AS s, l_linenumber, l_partkey, ext, day, s_name, s_nationkey,
    ROUND(ext * {_case(docs.RATE_BY_LINE, 'DECIMAL(6,4)')}, 2) * 100 AS fc FROM li WHERE l_returnflag = 'R')""",
    uses=("li",))
cte("form", f"""SELECT ledger_id, row_key, deductee_name, deductee_pan, deductee_type, section,
  CAST(gross_amount AS {M}) AS gross_amount, CAST(cents AS {M}) / 100 AS dd, CAST(CAST(cents AS {M}) * 0.01 AS {M}) AS tds_deducted,
  CAST(CASE WHEN k % 13 = 1 THEN CAST((cents + 1) // 2 AS {M}) * 0.01 ELSE CAST(cents AS {M}) * 0.01 END AS {M}) AS tds_deposited,
  CASE WHEN k % 17 = 5 THEN '' WHEN s % 10 = 3 THEN '12AB' ELSE lpad(CAST(s % 10000000 AS VARCHAR), 7, '0') END AS bsr_code,
  day + 7 AS challan_date, lpad(CAST(k % 100000 AS VARCHAR), 5, '0') AS challan_serial_no, day AS date_of_payment,
  CASE WHEN k % 19 = 7 THEN 'LDC-1' END AS certificate_no
  FROM (SELECT *, CAST(dcents AS HUGEINT) AS cents FROM f0)""", uses=("f0",))
FORM = ("form",)
cte("g1", f"""SELECT ledger_id, row_key, invoice_no, day AS invoice_date, CAST(price + 2 * tax AS {M}) AS invoice_value,
  CASE WHEN c % 10 = 9 THEN NULL WHEN c % 10 = 7 THEN state || 'BAD' || c
    ELSE state || 'ABCDE' || lpad(CAST(c % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS receiver_gstin,
  CASE WHEN k % 47 = 3 THEN 'Totally Different Trader' ELSE c_name END AS receiver_name,
  CASE WHEN k % 103 = 1 THEN '' WHEN k % 101 = 9 THEN '98-Nowhere' ELSE state || '-State' END AS place_of_supply,
  CAST(price AS {M}) AS taxable_value,
  CAST(CASE WHEN k % 109 = 2 THEN 0 WHEN NOT intra OR k % 113 = 3 THEN 2 * tax ELSE 0 END AS {M}) AS igst,
  CAST(CASE WHEN k % 109 = 2 THEN 0 WHEN intra OR k % 113 = 3 THEN tax ELSE 0 END AS {M}) AS cgst,
  CAST(CASE WHEN k % 109 = 2 THEN 0 WHEN intra OR k % 113 = 3 THEN tax ELSE 0 END AS {M}) AS sgst, CAST(0 AS {M}) AS cess,
  CASE WHEN k % 97 = 4 THEN 'EXPORT' WHEN k % 109 = 2 AND k % 2 = 0 THEN 'NIL'
    WHEN c % 10 NOT IN (7, 9) OR (c % 10 = 7 AND length(state || 'BAD' || c) = 15) THEN 'B2B' ELSE 'B2C' END AS supply_type,
  CASE WHEN k % 7 <> 3 THEN '8471' END AS hsn_code, k % 83 = 6 AS reverse_charge
  FROM (SELECT *, (nation = 24) <> (k % 53 = 0) AS intra, lpad(CAST(nation + 3 AS VARCHAR), 2, '0') AS state,
    nation AS ledger_id, k || '-' || copy AS row_key,
    CASE WHEN copy = 2 THEN 'EXT-' WHEN k % 71 = 5 THEN 'inv-' ELSE 'INV-' END || k AS invoice_no,
    CAST(CASE WHEN k % 89 = 1 THEN ROUND(ROUND(price * 0.09, 2) * 1.07, 2) ELSE ROUND(price * 0.09, 2) END AS {M}) AS tax
    FROM (SELECT o_orderkey AS k, CAST(o_totalprice AS {M}) AS price, CAST(o_orderdate AS DATE) AS day, c_custkey AS c,
      c_name, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 61 <> 0)
    JOIN (SELECT unnest([1, 2, 3]) AS copy) ON copy = 1 OR (copy = 2 AND k % 59 = 0)
      OR (copy = 3 AND k % 67 = 9 AND k % 59 <> 0))""")
G1 = ("g1",)


def _parsed_form(d):
    return T.parse_26q(docs.form_26q_raw(d.spark, d.sf_dir))


def _parsed_gstr1(d):
    return T.parse_gstr1(docs.gstr1_raw(d.spark, d.sf_dir))


def _form(d):
    """The parsed return, stored once like the ledger."""
    return staged(d.spark, "form_26q", d.sf_dir, lambda: _parsed_form(d))


def _gstr1(d):
    return staged(d.spark, "gstr1", d.sf_dir, lambda: _parsed_gstr1(d))


def dbl(cols: list[str]) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)


def sdbl(df, cols):
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def _tds(d):
    """The TDS slice of the ledger, stored once: five gap rules read it instead of the whole ledger."""
    return staged(d.spark, "tds_rows", d.sf_dir, lambda: D.filter_tds_rows(d.gl))


def _sales(d):
    return staged(d.spark, "sales_rows", d.sf_dir, lambda: D.filter_sales_rows(d.gl))


F_NUM = ["gross_amount", "tds_deducted", "tds_deposited"]
register("parse_26q", lambda d: sdbl(_parsed_form(d).drop("challan_amount", "date_of_deduction", "remarks", "nature_of_payment"), F_NUM),
         f"""SELECT ledger_id, row_key, deductee_name, deductee_pan, deductee_type, section, {dbl(F_NUM)}, bsr_code,
         challan_date, challan_serial_no, date_of_payment, certificate_no FROM form""", uses=FORM)
register("summary_26q", lambda d: T.summary_26q(_form(d)),
         f"""SELECT ledger_id, COUNT(*) AS total_rows, {r2('SUM(gross_amount)')} AS total_gross,
         {r2('SUM(tds_deducted)')} AS total_deducted, {r2('SUM(tds_deposited)')} AS total_deposited,
         {r2('SUM(tds_deducted - tds_deposited)')} AS gap, COUNT(DISTINCT deductee_pan) AS deductees,
         COUNT(DISTINCT section) AS sections, COUNT(DISTINCT bsr_code || '-' || challan_serial_no) AS challans,
         MIN(date_of_payment) AS period_start, MAX(date_of_payment) AS period_end FROM form GROUP BY 1""", uses=FORM)
_vals = ", ".join(f"('{c}', CAST({t} AS {M}), CAST({co} AS DECIMAL(6,4)), CAST({ind} AS DECIMAL(6,4)))"
                  for c, (t, co, ind) in T.TDS_SECTIONS.items())
cte("sec", f"""SELECT form.*, threshold,
  CASE WHEN regexp_matches(lower(deductee_type), '^c|company|pvt|ltd|llp') THEN rc ELSE ri END AS rate
  FROM form LEFT JOIN (SELECT * FROM (VALUES {_vals}) v(code, threshold, rc, ri)) v
  ON v.code = regexp_replace(upper(section), '^SEC\\.?', '')""", uses=FORM)
register("ref_tds_sections",
         lambda d: T.with_tds_section(_form(d)).groupBy("section", "deductee_type").agg(
             F.max("threshold").cast("double").alias("threshold"), F.max("expected_rate").cast("double").alias("rate"),
             F.count(F.lit(1)).alias("entries")),
         """SELECT section, deductee_type, CAST(MAX(threshold) AS DOUBLE) AS threshold, CAST(MAX(rate) AS DOUBLE) AS rate,
         COUNT(*) AS entries FROM sec GROUP BY 1, 2""", uses=("sec",))


def flag(code: str, sev: str, cat: str, one: str, many: str, cond: str, x: str, table: str) -> str:
    return issue(code, f"'{sev}'", cat, plural("n", one, many), "n", r2("x"),
                 f"(SELECT ledger_id, COUNT(*) AS n, {x} AS x FROM {table} WHERE {cond} GROUP BY 1)")


Q26 = {
    "26Q-PAN-001": flag("26Q-PAN-001", "critical", "PAN Validation", "deductee PAN invalid format", "deductee PANs invalid format",
                        "deductee_pan <> '' AND NOT regexp_full_match(deductee_pan, '[A-Z]{5}[0-9]{4}[A-Z]')",
                        "SUM(tds_deducted)", "sec"),
    "26Q-PAN-002": flag("26Q-PAN-002", "review", "PAN Validation", "deductee missing or invalid PAN",
                        "deductees missing or invalid PAN", "deductee_pan IN ('', 'PANNOTAVBL', 'PANINVALID')",
                        "SUM(gross_amount * 0.20 - tds_deducted)", "sec"),
    "26Q-BSR-001": flag("26Q-BSR-001", "critical", "Challan Validation", "challan with invalid BSR code",
                        "challans with invalid BSR code",
                        "bsr_code <> '' AND NOT regexp_full_match(bsr_code, '[0-9]{7}')", "SUM(tds_deposited)", "sec"),
    "26Q-SEC-001": flag("26Q-SEC-001", "review", "Section Validation", "entry with unrecognised TDS section",
                        "entries with unrecognised TDS section", "section <> '' AND threshold IS NULL",
                        "MAX(CAST(NULL AS DOUBLE))", "sec"),
    "26Q-RATE-001": flag("26Q-RATE-001", "review", "TDS Rate Check", "entry with lower-than-expected TDS rate",
                         "entries with lower-than-expected TDS rate",
                         """gross_amount > 0 AND rate <> 0 AND certificate_no IS NULL AND (
                         (tds_deducted > 0 AND tds_deducted < (rate - 0.005) * gross_amount)
                         OR (tds_deducted = 0 AND gross_amount >= threshold))""",
                         "SUM(GREATEST(0, gross_amount * rate - tds_deducted))", "sec"),
    "26Q-CHN-001": flag("26Q-CHN-001", "review", "Challan Validation", "TDS entry missing challan details",
                        "TDS entries missing challan details",
                        "tds_deducted > 0 AND (bsr_code = '' OR challan_serial_no = '' OR challan_date IS NULL)",
                        "SUM(tds_deducted)", "sec"),
    "26Q-DEP-001": issue("26Q-DEP-001", "'critical'", "Deducted vs Deposited", "'Gap between TDS deducted and deposited'",
                         "n", r2("x"), f"""(SELECT ledger_id, SUM(n) AS n, SUM(ABS(a - b)) AS x FROM (
                         SELECT ledger_id, bsr_code, challan_date, challan_serial_no, SUM(tds_deducted) AS a,
                           max_by(tds_deposited, {NATURAL}) AS b, COUNT(*) AS n FROM sec GROUP BY 1, 2, 3, 4)
                         WHERE b > 0 AND ABS(a - b) > 1 GROUP BY 1)"""),
}
for _n, _c in (("q26_pan_format", "26Q-PAN-001"), ("q26_pan_missing", "26Q-PAN-002"), ("q26_bsr_format", "26Q-BSR-001"),
               ("q26_unknown_section", "26Q-SEC-001"), ("q26_rate_deviation", "26Q-RATE-001"),
               ("q26_deposit_gap", "26Q-DEP-001"), ("q26_challan_missing", "26Q-CHN-001")):
    register(_n, lambda d, c=_c: T.issues_26q(_form(d), [c]), Q26[_c], uses=("sec",))
register("scan_26q", lambda d: T.issues_26q(_form(d)), "\nUNION ALL ".join(Q26.values()), uses=("sec",))
register("agg_first_by", lambda d: sdbl(T.deposit_gaps(_form(d)), ["deducted", "deposited", "gap"]),
         f"""SELECT ledger_id, bsr_code, challan_date, challan_serial_no, CAST(a AS DOUBLE) AS deducted,
         CAST(b AS DOUBLE) AS deposited, n, CAST(ABS(a - b) AS DOUBLE) AS gap FROM (SELECT ledger_id, bsr_code,
           challan_date, challan_serial_no, SUM(tds_deducted) AS a, max_by(tds_deposited, {NATURAL}) AS b,
           COUNT(*) AS n FROM form GROUP BY 1, 2, 3, 4) WHERE b > 0 AND ABS(a - b) > 1""", uses=FORM)

G_NUM = ["invoice_value", "taxable_value", "igst", "cgst", "sgst", "cess"]
register("parse_gstr1", lambda d: sdbl(_parsed_gstr1(d), G_NUM),
         f"""SELECT ledger_id, row_key, invoice_no, invoice_date, receiver_gstin, receiver_name, place_of_supply,
         {dbl(G_NUM)}, supply_type, hsn_code, reverse_charge FROM g1""", uses=G1)
POS = "substr(trim(place_of_supply), 1, 2)"
TAX = "(igst + cgst + sgst)"
RATE = f"CAST({TAX} AS DOUBLE) / CAST(taxable_value AS DOUBLE)"
G1Q = {
    "G1-GSTIN-001": flag("G1-GSTIN-001", "critical", "GSTIN Validation", "invoice with invalid receiver GSTIN",
                         "invoices with invalid receiver GSTIN",
                         "NOT regexp_full_match(upper(receiver_gstin), '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]')",
                         "SUM(invoice_value)", "g1"),
    "G1-POS-001": flag("G1-POS-001", "review", "Place of Supply", "invoice with invalid place of supply code",
                       "invoices with invalid place of supply code",
                       f"{POS} NOT IN ({', '.join(repr(s) for s in T.STATE_CODES)})", "MAX(CAST(NULL AS DOUBLE))", "g1"),
    "G1-TAX-001": flag("G1-TAX-001", "critical", "Tax Split", "invoice with incorrect IGST/CGST+SGST split",
                       "invoices with incorrect IGST/CGST+SGST split",
                       f"""NOT reverse_charge AND supply_type <> 'EXPORT' AND (({POS} = '27' AND igst > 0 AND cgst = 0
                       AND sgst = 0) OR ({POS} <> '27' AND igst = 0 AND (cgst > 0 OR sgst > 0)))""", f"SUM{TAX}", "g1"),
    "G1-TAX-002": flag("G1-TAX-002", "review", "Tax Calculation", "invoice with unexpected tax amount",
                       "invoices with unexpected tax amount",
                       f"""taxable_value > 0 AND {TAX} > 100 AND LEAST({', '.join(f'ABS({RATE} - {r})' for r in T.GST_RATES)})
                       > 0.005""", "SUM(taxable_value)", "g1"),
    "G1-DUP-001": issue("G1-DUP-001", "'critical'", "Duplicate Invoices",
                        plural("g", "duplicate invoice number found", "duplicate invoice numbers found"), "n", r2("x"),
                        """(SELECT ledger_id, COUNT(*) AS g, SUM(n) AS n, SUM(x) AS x FROM (SELECT ledger_id,
                        lower(trim(invoice_no)) AS i, COUNT(*) AS n, SUM(invoice_value) AS x FROM g1 GROUP BY 1, 2)
                        WHERE n > 1 GROUP BY 1)"""),
    "G1-HSN-001": flag("G1-HSN-001", "info", "HSN/SAC Code", "invoice above ₹50K missing HSN/SAC code",
                       "invoices above ₹50K missing HSN/SAC code", "invoice_value >= 50000 AND hsn_code IS NULL",
                       "MAX(CAST(NULL AS DOUBLE))", "g1"),
}
for _n, _c in (("g1_gstin_format", "G1-GSTIN-001"), ("g1_place_of_supply", "G1-POS-001"), ("g1_tax_split", "G1-TAX-001"),
               ("g1_tax_rate", "G1-TAX-002"), ("g1_duplicates", "G1-DUP-001"), ("g1_missing_hsn", "G1-HSN-001")):
    register(_n, lambda d, c=_c: T.issues_gstr1(_gstr1(d), [c]), G1Q[_c], uses=G1)
register("scan_gstr1", lambda d: T.issues_gstr1(_gstr1(d)), "\nUNION ALL ".join(G1Q.values()), uses=G1)

# --- summary returns ---------------------------------------------------------------

ZERO = "CAST(0 AS DOUBLE)"


def _cents(f: str) -> str:
    return f"CAST(SUM(price) * CAST({f} AS DECIMAL(6,4)) AS DECIMAL(20,2))"


def _share(f: str) -> str:
    return f"CAST({_cents(f)} AS DOUBLE)"


def _figures(**given: str) -> str:
    return ", ".join(f"{given.get(f, ZERO)} AS {f}" for f in T.ALIASES_3B)


register("parse_gstr3b", lambda d: T.parse_gstr3b(docs.gstr3b_wide_raw(d.spark, d.sf_dir)),
         f"""SELECT c_nationkey AS ledger_id, c_nationkey || '-' || year(day) || '-' || strftime(day, '%m') AS doc_id,
         strftime(day, '%m') || '-' || year(day) AS period, {_figures(
             outward_taxable_value=_share('1'), outward_igst=_share('0.18'), itc_igst=_share('0.05'),
             payable_igst=_share('0.13'), paid_igst=_share('0.12'))}
         FROM so GROUP BY 1, 2, 3""", uses=("so",))
register("parse_gstr3b_labels", lambda d: T.parse_gstr3b(docs.gstr3b_label_raw(d.spark, d.sf_dir)),
         f"""SELECT c_nationkey AS ledger_id, c_nationkey || '-' || year(day) AS doc_id, '' AS period, {_figures(
             outward_taxable_value=_share('1'),
             outward_igst="CAST(" + " + ".join(_cents(f) for f in ("0.18", "0.05", "0.13", "0.12")) + " AS DOUBLE)",
             itc_igst=_share('0.05'), payable_igst=_share('0.13'), paid_igst=_share('0.12'))}
         FROM so GROUP BY 1, 2, 3""", uses=("so",))
cte("itr_rows", """SELECT c_nationkey AS ledger_id, c_nationkey || '-' || year(day) AS doc_id, quarter(day) AS q,
  year(day) AS yy, SUM(price) AS p FROM so GROUP BY 1, 2, 3, 4""", uses=("so",))


def _first(f: str, cond: str = "TRUE") -> str:
    return (f"COALESCE(CAST(min_by(CAST(p * CAST({f} AS DECIMAL(6,4)) AS DECIMAL(20,2)), q) FILTER ({cond}) AS DOUBLE), 0)")


register("parse_itr", lambda d: T.parse_itr(docs.itr_raw(d.spark, d.sf_dir)),
         f"""SELECT ledger_id, doc_id, assessment_year, itr_form, gti AS gross_total_income,
         CASE WHEN ti <> 0 THEN ti ELSE gti END AS taxable_income, tax_payable, tax_paid,
         CAST(CAST(GREATEST(0, tax_paid - tax_payable) AS DECIMAL(20,2)) AS DOUBLE) AS refund_due, filing_date FROM (
         SELECT ledger_id, doc_id, 'AY ' || MAX(yy) AS assessment_year, 'ITR' AS itr_form,
         {_first('1', 'NOT (ledger_id % 3 = 0 AND q = 1)')} AS gti, {_first('0.9', 'ledger_id % 4 <> 1')} AS ti,
         {_first('0.3')} AS tax_payable,
         CASE WHEN ledger_id % 2 = 0 THEN {_first('0.35')} ELSE {_first('0.2')} END AS tax_paid,
         DATE '2002-07-31' AS filing_date FROM itr_rows GROUP BY 1, 2) WHERE gti <> 0 OR ti <> 0""", uses=("itr_rows",))

# --- ledger against documents -------------------------------------------------------

TXT = ["account_name", "account_group", "description"]
IS_TDS = kw([*TXT, "voucher_type"], D.TDS_WORDS)
IS_SALE = f"({kw(TXT, D.SALES_WORDS)} OR {kw('voucher_type', D.SALES_VOUCHERS)})"
IS_BUY = f"({kw(TXT, D.PURCHASE_WORDS)} OR {kw('voucher_type', D.PURCHASE_VOUCHERS)})"
EFF = "CASE WHEN net_amount <> 0 THEN ABS(net_amount) ELSE ABS(CASE WHEN debit_amount <> 0 THEN debit_amount ELSE credit_amount END) END"
for _n, _f, _c in (("filter_tds_rows", D.filter_tds_rows, IS_TDS), ("filter_sales_rows", D.filter_sales_rows, IS_SALE),
                   ("filter_purchase_rows", D.filter_purchase_rows, IS_BUY)):
    register(_n, lambda d, f=_f: f(d.gl).select("ledger_id", "row_id"), f"SELECT ledger_id, row_id FROM gl WHERE {_c}")


def norm(c: str) -> str:
    strip = f"regexp_replace(lower({c}), '\\bpvt\\b|\\bltd\\b|\\blimited\\b|\\bprivate\\b|\\bllp\\b', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({strip}, '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def toks(c: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(c)}, ' '), lambda t: t <> ''))"


def sim(a: str, b: str) -> str:
    return (f"CASE WHEN len({toks(a)}) = 0 OR len({toks(b)}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect({toks(a)}, {toks(b)})) "
            f"AS DOUBLE) / GREATEST(len({toks(a)}), len({toks(b)})) END")


def gap(code: str, sev: str, party: str, ref: str, gl: str, doc: str, var: str, src: str) -> str:
    n = lambda x: "CAST(NULL AS DOUBLE)" if x == "NULL" else r2(x)
    return (f"SELECT ledger_id, '{code}' AS code, {sev} AS severity, CAST({party} AS VARCHAR) AS party, "
            f"CAST({ref} AS VARCHAR) AS reference, {n(gl)} AS gl_amount, {n(doc)} AS doc_amount, {n(var)} AS variance FROM {src}")


cte("tds_gl", f"""SELECT *, {EFF} AS eff, COALESCE(party_name, vendor_name, customer_name, '') AS party
  FROM gl WHERE {IS_TDS}""", uses=("gl",))
cte("ded", f"""SELECT ledger_id, CASE WHEN deductee_pan <> '' THEN deductee_pan ELSE lower(trim(deductee_name)) END AS key,
  min_by(deductee_name, {NATURAL}) AS name, min_by(deductee_pan, {NATURAL}) AS pan, SUM(tds_deducted) AS deducted
  FROM form GROUP BY 1, 2""", uses=FORM)
cte("pairs", f"""SELECT * FROM (SELECT a.ledger_id, a.name AS left_name, b.party AS right_name,
  {sim('a.name', 'b.party')} AS similarity FROM (SELECT DISTINCT ledger_id, name FROM ded) a
  JOIN (SELECT DISTINCT ledger_id, party FROM tds_gl WHERE party <> '') b ON a.ledger_id = b.ledger_id)
  WHERE similarity > 0.5""", uses=("ded", "tds_gl"))
cte("per_name", """SELECT d.*, m.gl FROM ded d LEFT JOIN (SELECT p.ledger_id, p.left_name, SUM(eff) AS gl FROM pairs p
  JOIN tds_gl g ON p.ledger_id = g.ledger_id AND p.right_name = g.party GROUP BY 1, 2) m
  ON d.ledger_id = m.ledger_id AND d.name = m.left_name""", uses=("pairs",))
BOTH = """(SELECT COALESCE(a.ledger_id, b.ledger_id) AS ledger_id, COALESCE(g, 0) AS g, COALESCE(d, 0) AS d
  FROM (SELECT ledger_id, SUM(eff) AS g FROM {gl} GROUP BY 1) a
  FULL JOIN (SELECT ledger_id, SUM({col}) AS d FROM {doc} GROUP BY 1) b ON a.ledger_id = b.ledger_id)"""
T26 = BOTH.format(gl="tds_gl", col="tds_deducted", doc="form")
GAP26 = {
    "gl26q_001": gap("GL26Q-001", "CASE WHEN ABS(g - d) > 10000 THEN 'critical' ELSE 'review' END", "NULL", "NULL",
                     "g", "d", "ABS(g - d)", f"{T26} WHERE ABS(g - d) > 1"),
    "gl26q_002": gap("GL26Q-002", "'review'", "name", "NULLIF(pan, '')", "NULL", "deducted", "deducted",
                     "per_name WHERE gl IS NULL"),
    "gl26q_003": gap("GL26Q-003", "CASE WHEN ABS(gl - deducted) > 5000 THEN 'critical' ELSE 'review' END", "name",
                     "NULLIF(pan, '')", "gl", "deducted", "ABS(gl - deducted)", "per_name WHERE ABS(gl - deducted) > 1"),
    "gl26q_004": gap("GL26Q-004", "'info'", "party", "reference_number", "eff", "NULL", "eff",
                     """tds_gl WHERE party <> '' AND NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.ledger_id = tds_gl.ledger_id AND pairs.right_name = tds_gl.party)"""),
    "gl26q_005": gap("GL26Q-005", "CASE WHEN x > 5000 THEN 'critical' ELSE 'review' END", "NULL", "NULL", "NULL", "x", "x",
                     "(SELECT ledger_id, SUM(tds_deducted) - SUM(tds_deposited) AS x FROM form GROUP BY 1) WHERE x > 1"),
}
USES26 = ("per_name",)
for _n, _sql in GAP26.items():
    register(_n, lambda d, c=_n.upper().replace("_", "-"): D.gl_26q_gaps(_tds(d), _form(d)).filter(F.col("code") == c),
             _sql, uses=USES26)
register("fuzzy_party_join", lambda d: D.party_matches(_tds(d), _form(d)), "SELECT * FROM pairs", uses=("pairs",))
register("name_similarity",
         lambda d: d.gl.filter("party_name IS NOT NULL").select("ledger_id", "party_name", "description").distinct()
         .withColumn("similarity", N.name_similarity(F.col("party_name"), F.col("description"))),
         f"""SELECT ledger_id, party_name, description, {sim('party_name', 'description')} AS similarity FROM (
         SELECT DISTINCT ledger_id, party_name, description FROM gl WHERE party_name IS NOT NULL)""")

cte("sales_gl", f"""SELECT *, {EFF} AS eff, upper(trim(reference_number)) AS ref FROM gl WHERE {IS_SALE}""", uses=("gl",))
cte("inv", f"""SELECT ledger_id, upper(trim(invoice_no)) AS ref, SUM(taxable_value) AS taxable,
  min_by(COALESCE(receiver_name, ''), {NATURAL}) AS receiver FROM g1 GROUP BY 1, 2""", uses=G1)
TG1 = BOTH.format(gl="sales_gl", col="taxable_value", doc="g1")
MIX = "supply_type = 'B2B' AND receiver_gstin IS NOT NULL AND igst > 0 AND (cgst > 0 OR sgst > 0)"
NIL = f"taxable_value > 100000 AND {TAX} = 0 AND supply_type <> 'NIL'"
GAPG1 = {
    "gl_gstr1_001": gap("G1GL-001", "CASE WHEN ABS(g - d) > 50000 THEN 'critical' ELSE 'review' END", "NULL", "NULL", "g", "d",
                        "ABS(g - d)", f"{TG1} WHERE ABS(g - d) > 100"),
    "gl_gstr1_002": gap("G1GL-002", "'review'", "COALESCE(customer_name, party_name)", "ref", "eff", "NULL", "eff",
                        "sales_gl WHERE ref <> '' AND NOT EXISTS (SELECT 1 FROM inv WHERE inv.ledger_id = sales_gl.ledger_id AND inv.ref = sales_gl.ref)"),
    "gl_gstr1_003": gap("G1GL-003", "'review'", "NULLIF(receiver, '')", "ref", "NULL", "taxable", "taxable",
                        "inv WHERE NOT EXISTS (SELECT 1 FROM sales_gl WHERE sales_gl.ledger_id = inv.ledger_id AND sales_gl.ref = inv.ref AND sales_gl.ref <> '')"),
    "gl_gstr1_004": gap("G1GL-004", "'review'", "NULL", "NULL", "NULL", "a", "b",
                        f"(SELECT ledger_id, SUM(taxable_value) AS a, SUM{TAX} AS b FROM g1 WHERE {MIX} GROUP BY 1)"),
    "gl_gstr1_005": gap("G1GL-005", "'info'", "NULL", "NULL", "NULL", "a", "0",
                        f"(SELECT ledger_id, SUM(taxable_value) AS a FROM g1 WHERE {NIL} GROUP BY 1)"),
    "gl_gstr1_006": gap("G1GL-006", "'info'", "p", "ref", "eff", "taxable", "0",
                        f"""(SELECT s.ledger_id, s.ref, s.eff, taxable, receiver, COALESCE(customer_name, party_name, '') AS p
                        FROM sales_gl s JOIN inv ON s.ledger_id = inv.ledger_id AND s.ref = inv.ref)
                        WHERE p <> '' AND receiver <> '' AND {sim('p', 'receiver')} < 0.4"""),
}
USESG1 = ("sales_gl", "inv")
for _n, _sql in GAPG1.items():
    register(_n, lambda d, c="G1GL-" + _n[-3:]: D.gl_gstr1_gaps(_sales(d), _gstr1(d)).filter(F.col("code") == c), _sql, uses=USESG1)
register("invoice_anti_both", lambda d: D.invoice_anti_both(_sales(d), _gstr1(d)),
         GAPG1["gl_gstr1_002"] + "\nUNION ALL " + GAPG1["gl_gstr1_003"], uses=USESG1)


def summary(totals: str, gaps: dict[str, str]) -> str:
    return f"""WITH t AS {totals}, x AS ({' UNION ALL '.join(gaps.values())}),
    s AS (SELECT ledger_id, SUM(CAST(variance AS DECIMAL(38,2))) AS u, COUNT(*) AS n,
      COUNT(*) FILTER (severity = 'critical') AS c, COUNT(*) FILTER (severity = 'review') AS r,
      COUNT(*) FILTER (severity = 'info') AS i FROM x GROUP BY 1)
    SELECT t.ledger_id, {r2('g')} AS gl_total, {r2('d')} AS doc_total,
    {r2('GREATEST(0, LEAST(g, d) - ABS(g - d))')} AS matched_total, CAST(COALESCE(u, 0) AS DOUBLE) AS unmatched_total,
    COALESCE(n, 0) AS total_gaps, COALESCE(c, 0) AS critical, COALESCE(r, 0) AS review, COALESCE(i, 0) AS info
    FROM t LEFT JOIN s USING (ledger_id)"""


register("doc_recon_summary", lambda d: D.doc_recon_summary("26q", _tds(d), _form(d)), summary(T26, GAP26), uses=USES26)
register("doc_recon_summary_gstr1", lambda d: D.doc_recon_summary("gstr1", _sales(d), _gstr1(d)), summary(TG1, GAPG1), uses=USESG1)


def _vendor(d):
    bills = d.gl.filter("voucher_type = 'Purchase' AND vendor_name IS NOT NULL").select(
        "ledger_id", F.col("vendor_name").alias("vendor"), F.col("reference_number").alias("invoice_no"),
        F.col("transaction_date").alias("invoice_date"), F.col("credit_amount").alias("amount"))
    return D.vendor_compliance_rollup(bills, docs.gstr2b(d.spark, d.sf_dir))


register("vendor_compliance_rollup", _vendor, f"""
  WITH known AS (SELECT s_nationkey AS ledger_id, 'PUR-' || k || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS i,
    BOOL_AND(k % 31 <> 4) AS ok FROM li WHERE k % 29 <> 3 GROUP BY 1, 2)
  SELECT g.ledger_id, vendor_name AS vendor, strftime(transaction_date, '%m-%Y') AS period, COUNT(*) AS invoices_total,
    COUNT(*) FILTER (NOT COALESCE(ok, FALSE)) AS invoices_at_risk,
    {r2('SUM(CASE WHEN NOT COALESCE(ok, FALSE) THEN credit_amount ELSE 0 END)')} AS amount_at_risk
  FROM gl g LEFT JOIN known ON g.ledger_id = known.ledger_id AND g.reference_number = known.i
  WHERE voucher_type = 'Purchase' AND vendor_name IS NOT NULL GROUP BY 1, 2, 3""", uses=("gl", "li"))
