"""Named queries for reconciliations, flux and the P&L review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flux as X
from ..operators import recon as R
from ..sources.trade_ledger import PERIOD
from .check_queries import BUCKET, E, S
from .registry import cte, register
from .report_queries import kw, r2, topk

NET = "(debit_amount - credit_amount)"
IN_P = f"transaction_date BETWEEN {S} AND {E}"
UPTO = f"transaction_date <= {E}"
VT = "lower(coalesce(voucher_type, ''))"
ACCT = "lower(coalesce(account_name, ''))"

cte("buckets", f"SELECT ledger_id, account_name, {BUCKET} AS bucket FROM types", uses=("types",))


def own(bucket: str, fallback: str) -> str:
    return f"""(SELECT g.*, CASE WHEN h.has THEN COALESCE(b.bucket = '{bucket}', FALSE)
      ELSE {kw('g.account_name', [fallback])} END AS own
      FROM gl g LEFT JOIN buckets b ON g.ledger_id = b.ledger_id AND g.account_name = b.account_name
      LEFT JOIN (SELECT ledger_id, BOOL_OR(COALESCE(bucket = '{bucket}', FALSE)) AS has FROM buckets GROUP BY 1) h
      ON g.ledger_id = h.ledger_id)"""


def result(name: str, src: str, tgt: str, threshold: float, table: str) -> str:
    return f"""SELECT ledger_id, '{name}' AS recon, {r2('s')} AS source_balance, {r2('t')} AS target_balance,
      {r2('ABS(s - t)')} AS variance, CAST({threshold} AS DOUBLE) AS threshold,
      CASE WHEN ABS(s - t) <= {threshold} THEN 'PASSED' ELSE 'FAILED' END AS status
      FROM (SELECT ledger_id, SUM(CASE WHEN {src[0]} THEN {src[1]} ELSE 0 END) AS s,
        {tgt} AS t FROM {table} GROUP BY 1)"""


def cond(c: str, v: str) -> str:
    return f"SUM(CASE WHEN {c} THEN {v} ELSE 0 END)"


VEND, VEND1 = "COALESCE(vendor_name, party_name) <> ''", "vendor_name <> ''"
CUST, CUST1 = "COALESCE(customer_name, party_name) <> ''", "customer_name <> ''"
SALES_IN = f"{VT} IN ('sales', 'tax invoice', 'sales invoice')"
SQL = {
    "recon_ap": result("recon_ap", (f"own AND {UPTO}", f"-{NET}"), cond(f"own AND {UPTO} AND {VEND}", f"-{NET}"), 1,
                       own("payable", "payable")),
    "recon_ar": result("recon_ar", (f"own AND {UPTO}", NET), cond(f"own AND {UPTO} AND {CUST}", NET), 1,
                       own("receivable", "receivable")),
    "recon_gst_output": result(
        "recon_gst_output", (f"{IN_P} AND {kw('account_name', ['cgst output', 'sgst output', 'igst output'])}", f"-{NET}"),
        f"0.18 * {cond(f'''{IN_P} AND {SALES_IN} AND {ACCT} LIKE 'sales%' ''', f'-{NET}')}", 100, "gl"),
    "recon_inventory": result(
        "recon_inventory", (f"own AND {IN_P}", NET),
        f"""SUM(CASE WHEN NOT ({IN_P}) OR transaction_date IS NULL THEN 0
          WHEN {VT} IN ('purchase', 'purchase invoice', 'material receipt', 'goods receipt')
            AND account_name IS NOT NULL AND NOT {kw('account_name', ['gst', 'creditor', 'payable'])} THEN {NET}
          WHEN {SALES_IN} AND ({ACCT} LIKE 'cogs%' OR {ACCT} LIKE '%cost of goods%') THEN -{NET} ELSE 0 END)""",
        1000, own("inventory", "stock")),
    "recon_tpl_bank": result("recon_tpl_bank", (f"own AND {UPTO}", f"-{NET}"), cond(f"own AND {IN_P}", f"-{NET}"), 0,
                             own("bank", "bank")),
    "recon_tpl_ap": result("recon_tpl_ap", (f"own AND {UPTO}", NET), cond(f"own AND {UPTO} AND {VEND1}", NET), 1,
                           own("payable", "payable")),
    "recon_tpl_ar": result("recon_tpl_ar", (f"own AND {UPTO}", f"-{NET}"),
                           cond(f"own AND {UPTO} AND {CUST1}", f"-{NET}"), 1, own("receivable", "receivable")),
    "recon_tpl_gst": result(
        "recon_tpl_gst", (f"own AND {IN_P}", f"-{NET}"),
        f"""SUM(CASE WHEN NOT (own AND {IN_P}) OR transaction_date IS NULL THEN 0 WHEN {SALES_IN} THEN credit_amount
          WHEN {VT} IN ('purchase', 'purchase invoice') THEN -debit_amount ELSE -{NET} END)""", 1, own("tax", "gst")),
    "recon_tpl_inventory": result(
        "recon_tpl_inventory", (f"own AND {UPTO}", NET),
        cond(f"""own AND {UPTO} AND {VT} IN ('stock journal', 'material receipt', 'goods receipt', 'purchase',
          'stock transfer')""", NET), 100, own("inventory", "stock")),
    "recon_bank_internal": result(
        "recon_bank_internal", (f"own AND {IN_P}", NET),
        f"""COALESCE(SUM(CASE WHEN NOT own AND {IN_P} AND touch THEN -{NET} END), 0)""", 1,
        f"""(SELECT o.*, BOOL_OR(own AND {IN_P}) OVER (PARTITION BY ledger_id, reference_number)
          AND reference_number IS NOT NULL AS touch FROM {own('bank', 'bank')} o)"""),
}
FRAGMENT = "creditor"
SQL["recon_watch_account"] = result(
    "recon_watch_account", (f"{IN_P} AND {ACCT} LIKE '%{FRAGMENT}%'", NET),
    cond(f"{IN_P} AND {ACCT} LIKE '%{FRAGMENT}%' AND reference_number IS NOT NULL", NET), 1, "gl")
PARTY = "supplier#000000001"
SQL["recon_watch_party"] = result(
    "recon_watch_party", (f"{IN_P} AND lower(coalesce(party_name, '')) LIKE '%{PARTY}%'", NET),
    cond(f"{IN_P} AND lower(coalesce(party_name, '')) LIKE '%{PARTY}%' AND reference_number IS NOT NULL", NET), 1, "gl")
TYPED = ("buckets",)

for _n in [*R.BY_NAME, "recon_bank_internal"]:
    register(_n, lambda d, n=_n: R.recon(n, d.gl, *d.period, d.overrides), SQL[_n], uses=TYPED)
register("recon_watch_account", lambda d: R.recon_watch_account(d.gl, *d.period, FRAGMENT), SQL["recon_watch_account"])
register("recon_watch_party", lambda d: R.recon_watch_party(d.gl, *d.period, PARTY), SQL["recon_watch_party"])
ALL_RECONS = "\nUNION ALL ".join(SQL[n] for n in [*R.BY_NAME, "recon_bank_internal"])
cte("recons", ALL_RECONS, uses=TYPED)
register("recon_run", lambda d: R.recon_run(d.rollups, *d.period, d.overrides), "SELECT * FROM recons", uses=("recons",))

LINE = (f"ledger_id, row_id, reference_number, transaction_date, account_name, "
        f"CAST(debit_amount AS DOUBLE) AS debit_amount, CAST(credit_amount AS DOUBLE) AS credit_amount")


def failed(name: str) -> str:
    return f"ledger_id IN (SELECT ledger_id FROM ({SQL[name]}) WHERE status = 'FAILED')"


for _n, _who, _b in (("recon_ap", "vendor_name", "payable"), ("recon_ar", "customer_name", "receivable")):
    register(f"{_n}_detail", lambda d, n=_n: R.unattributed_rows(n, d.gl, *d.period, d.overrides),
             f"""SELECT {LINE} FROM {own(_b, _b)} WHERE own AND {UPTO} AND COALESCE({_who}, '') = ''
             AND COALESCE(party_name, '') = '' AND {failed(_n)}""", uses=TYPED)
for _n, _b, _f in (("recon_tpl_bank", "bank", "bank"), ("recon_tpl_gst", "tax", "gst")):
    register(f"{_n}_detail", lambda d, n=_n: R.control_rows(n, d.gl, *d.period, d.overrides),
             f"SELECT {LINE}, CAST(-{NET} AS DOUBLE) AS net FROM {own(_b, _f)} WHERE own AND {IN_P} AND {failed(_n)}", uses=TYPED)
for _n, _b, _w, _s in (("recon_tpl_ap", "payable", "vendor_name", ""), ("recon_tpl_ar", "receivable", "customer_name", "-")):
    register(f"{_n}_detail", lambda d, n=_n: R.party_outstanding(n, d.gl, *d.period, d.overrides),
             f"""SELECT ledger_id, COALESCE(party_name, {_w}, account_name) AS party,
             {r2(f'{_s}SUM{NET}')} AS outstanding FROM {own(_b, _b)} WHERE own AND {UPTO} AND {failed(_n)}
             GROUP BY 1, 2 HAVING ABS(SUM{NET}) > 0.01""", uses=TYPED)
register("recon_bank_internal_detail", lambda d: R.unbalanced_bank_rows(d.gl, *d.period, d.overrides),
         f"""SELECT {LINE} FROM gl WHERE (ledger_id, reference_number) IN (SELECT (ledger_id, reference_number)
         FROM {own('bank', 'bank')} WHERE own AND {IN_P} AND reference_number IS NOT NULL
         GROUP BY ledger_id, reference_number HAVING ABS(SUM{NET}) > 0.01) AND {failed('recon_bank_internal')}""", uses=TYPED)
register("voucher_anti",
         lambda d: R.voucher_anti(d.gl, *d.period).select("ledger_id", "row_id", "reference_number"),
         f"""SELECT ledger_id, row_id, reference_number FROM gl s WHERE {IN_P} AND {SALES_IN} AND reference_number IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM gl t WHERE t.ledger_id = s.ledger_id AND t.reference_number = s.reference_number
           AND lower(coalesce(t.account_name, '')) LIKE '%gst%')""")
register("voucher_semi",
         lambda d: R.voucher_semi(d.gl, *d.period).groupBy("ledger_id", "account_name").agg(
             F.count(F.lit(1)).alias("legs"), F.round(F.sum("net_amount"), 2).cast("double").alias("net")),
         f"""SELECT ledger_id, account_name, COUNT(*) AS legs, {r2('SUM(net_amount)')} AS net FROM gl
         WHERE {IN_P} AND NOT {kw('account_name', ['bank', 'cash'])} AND (ledger_id, reference_number) IN (
           SELECT (ledger_id, reference_number) FROM gl WHERE {IN_P} AND {kw('account_name', ['bank', 'cash'])}
           AND reference_number IS NOT NULL) GROUP BY 1, 2""")

# --- flux and P&L ----------------------------------------------------------------

P0, P1 = (f"DATE '{x}'" for x in X.prior_period(*PERIOD))
IN_PRIOR = f"transaction_date BETWEEN {P0} AND {P1}"
cte("periods2", f"""SELECT a.*, COALESCE(t.account_type, 'UNKNOWN') AS account_type FROM (
  SELECT ledger_id, account_name, {cond(IN_P, NET)} AS c, {cond(IN_PRIOR, NET)} AS p,
  COUNT(*) FILTER ({IN_P}) AS n0, COUNT(*) FILTER ({IN_PRIOR}) AS n1
  FROM gl WHERE account_name <> '' AND transaction_date BETWEEN {P0} AND {E} GROUP BY 1, 2) a
  LEFT JOIN types t ON a.ledger_id = t.ledger_id AND a.account_name = t.account_name""", uses=("types",))
cte("flux", f"""SELECT ledger_id, account_name, account_type, {r2('c')} AS current_balance, {r2('p')} AS prior_balance,
  {r2('c - p')} AS variance,
  CASE WHEN p <> 0 THEN ROUND(CAST(c - p AS DOUBLE) / CAST(ABS(p) AS DOUBLE) * 100, 4) END AS variance_pct,
  p = 0 AS is_new_activity,
  ABS(c - p) >= 50000 AND (p = 0 OR ABS(c - p) * 100 >= ABS(p) * 10) AS is_material
  FROM periods2 WHERE ABS(c) >= 1 OR ABS(p) >= 1""", uses=("periods2",))
register("flux", lambda d: X.sort_material_first(X.flux(d.rollups, *d.period, d.overrides)), "SELECT * FROM flux",
         uses=("flux",))
register("flux_totals", lambda d: X.flux_totals(X.flux(d.gl, *d.period, d.overrides)),
         """SELECT ledger_id, COUNT(*) AS total_accounts, COUNT(*) FILTER (is_material) AS material_count,
         CAST(COALESCE(SUM(CAST(ABS(variance) AS DECIMAL(38,2))) FILTER (is_material), 0) AS DOUBLE)
         AS total_abs_variance FROM flux GROUP BY 1""", uses=("flux",))
register("prior_period",
         lambda d: d.gl.groupBy("ledger_id").agg(F.min("transaction_date").alias("s"), F.max("transaction_date").alias("e"))
         .select("ledger_id", *[c.alias(n) for c, n in zip(X.prior_period_columns(F.col("s"), F.col("e")),
                                                           ("prior_start", "prior_end"))]),
         """SELECT ledger_id, s - 1 - CAST(e - s AS INTEGER) AS prior_start, s - 1 AS prior_end FROM (
         SELECT ledger_id, MIN(transaction_date) AS s, MAX(transaction_date) AS e FROM gl GROUP BY 1)""")
register("period_full_outer",
         lambda d: X.account_periods(d.gl, *d.period).select(
             "ledger_id", "account_name", F.round("current", 2).cast("double").alias("current"),
             F.round("prior", 2).cast("double").alias("prior")),
         f"""SELECT COALESCE(a.ledger_id, b.ledger_id) AS ledger_id, COALESCE(a.account_name, b.account_name)
           AS account_name, {r2('COALESCE(a.v, 0)')} AS current, {r2('COALESCE(b.v, 0)')} AS prior
         FROM (SELECT ledger_id, account_name, SUM{NET} AS v FROM gl WHERE {IN_P} AND account_name <> '' GROUP BY 1, 2) a
         FULL JOIN (SELECT ledger_id, account_name, SUM{NET} AS v FROM gl WHERE {IN_PRIOR} AND account_name <> ''
           GROUP BY 1, 2) b ON a.ledger_id = b.ledger_id AND a.account_name = b.account_name""")


def pl(kind: str, col: str) -> str:
    sign = "-" if kind in ("REVENUE", "OTHER_INCOME") else ""
    return f"COALESCE({sign}SUM({col}) FILTER (account_type = '{kind}'), 0)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ROUND(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100, 4) ELSE 0 END"


cte("pl", f"""SELECT ledger_id, {pl('REVENUE', 'c')} AS rev, {pl('COGS', 'c')} AS cg, {pl('EXPENSE', 'c')} AS ex,
  {pl('OTHER_INCOME', 'c')} AS oi, {pl('REVENUE', 'p')} AS prev, {pl('COGS', 'p')} AS pcg
  FROM periods2 GROUP BY 1""", uses=("periods2",))
register("pl_numbers", lambda d: X.pl_numbers(d.gl, *d.period, d.overrides),
         f"""SELECT ledger_id, {r2('rev')} AS revenue, {r2('cg')} AS cogs, {r2('rev - cg')} AS gross_profit,
         {pct('(rev - cg)', 'rev')} AS gross_margin_pct, {r2('ex')} AS operating_expenses,
         {r2('rev - cg - ex')} AS operating_profit, {r2('oi')} AS other_income,
         {pct('(rev - cg - ex + oi)', 'rev')} AS net_profit_pct FROM pl""", uses=("pl",))
PL_IN = "account_type IN ('REVENUE', 'COGS', 'EXPENSE', 'OTHER_INCOME')"
_missing = "\nUNION ALL ".join(
    f"""SELECT ledger_id, 'missing_{w}', NULL, 9, 50000.0 FROM periods2 GROUP BY 1
    HAVING NOT BOOL_OR({PL_IN} AND n0 > 0 AND lower(account_name) LIKE '%{w}%')
    AND BOOL_OR(n1 > 0 AND lower(account_name) LIKE '%{w}%')""" for w in X.STANDARD_ACCOUNTS)
cte("triggers", f"""SELECT *, reason || ':' || COALESCE(account, 'general') AS pattern_key FROM (
  SELECT ledger_id, CASE WHEN p = 0 THEN 'new_activity' ELSE 'material_variance' END AS reason, account_name AS account,
    CASE WHEN p = 0 THEN 8 WHEN ABS(c) - ABS(p) > ABS(p) THEN 10 ELSE 7 END AS priority, {r2('ABS(c)')} AS impact
  FROM periods2 WHERE {PL_IN} AND n0 > 0 AND ((p = 0 AND ABS(c) > 50000)
    OR (p <> 0 AND ABS(ABS(c) - ABS(p)) * 100 > ABS(p) * 25 AND ABS(ABS(c) - ABS(p)) > 50000))
  UNION ALL {_missing}
  UNION ALL SELECT ledger_id, 'margin_shift', NULL, 8, 50000.0 FROM pl WHERE rev > 0 AND prev > 0
    AND ABS({pct('(rev - cg)', 'rev')} - {pct('(prev - pcg)', 'prev')}) > 15)""", uses=("pl", "periods2"))
register("pl_triggers", lambda d: X.pl_triggers(d.gl, *d.period, d.overrides), "SELECT * FROM triggers",
         uses=("triggers",))

ACC = "Sundry Creditors"
ROWS = f"FROM gl WHERE account_name = '{ACC}' AND {IN_P}"
register("acct_summary", lambda d: X.acct_summary(d.gl, ACC, *d.period),
         f"""SELECT ledger_id, account_name, {r2('SUM(debit_amount)')} AS total_debit,
         {r2('SUM(credit_amount)')} AS total_credit, {r2(f'SUM{NET}')} AS net_dr_cr, COUNT(*) AS entry_count
         {ROWS} GROUP BY 1, 2""")
register("acct_compare", lambda d: X.acct_compare(d.gl, ACC, *d.period),
         f"""SELECT ledger_id, {r2('p')} AS prior_net, {r2('c')} AS current_net, {r2('c - p')} AS variance,
         CASE WHEN p <> 0 THEN ROUND(CAST(c - p AS DOUBLE) / CAST(ABS(p) AS DOUBLE) * 100, 4) END AS variance_pct
         FROM periods2 WHERE account_name = '{ACC}'""", uses=("periods2",))
register("acct_top_entries", lambda d: X.acct_top_entries(d.gl, ACC, *d.period),
         topk(f"""SELECT ledger_id, row_id, transaction_date, reference_number, voucher_type,
         CAST(GREATEST(debit_amount, credit_amount) AS DOUBLE) AS amount, description {ROWS}""",
              "amount DESC, row_id", 5))
register("acct_by_voucher", lambda d: X.acct_by_voucher(d.gl, ACC, *d.period),
         f"""SELECT ledger_id, voucher_type, COUNT(*) AS count, {r2('SUM(debit_amount)')} AS total_debit,
         {r2('SUM(credit_amount)')} AS total_credit {ROWS} GROUP BY 1, 2""")
register("acct_find", lambda d: X.acct_find(d.gl, "%GST%", *d.period),
         f"""SELECT ledger_id, account_name, COUNT(*) AS entry_count, {r2('SUM(debit_amount)')} AS total_debit,
         {r2('SUM(credit_amount)')} AS total_credit FROM gl WHERE lower(account_name) LIKE '%gst%' AND {IN_P}
         GROUP BY 1, 2""")


def _claims(d):
    """Claims to verify: each ledger's creditor figure as stated, every fifth ledger off by 100."""
    stated = X.acct_summary(d.gl, ACC, *d.period).select("ledger_id", F.col("net_dr_cr").alias("claimed"))
    claims = stated.withColumn("claimed", F.when(F.col("ledger_id") % 5 == 0, F.col("claimed") + 100)
                               .otherwise(F.col("claimed")))
    actual = X.acct_compare(d.gl, ACC, *d.period).select("ledger_id", F.col("current_net").alias("actual"))
    return X.claim_check(claims, actual, ["ledger_id"]).select("ledger_id", "verified")


register("claim_check", _claims,
         f"SELECT ledger_id, ledger_id % 5 <> 0 AS verified FROM periods2 WHERE account_name = '{ACC}' AND n0 > 0",
         uses=("periods2",))
