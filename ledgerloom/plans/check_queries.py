"""Named queries for account classification and the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import checks as C
from ..operators import dup_windows as W
from ..sources.trade_ledger import PERIOD
from .registry import cte, register
from .report_queries import kw, r2

S, E = f"DATE '{PERIOD[0]}'", f"DATE '{PERIOD[1]}'"


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def group_case(col: str) -> str:
    whens = " ".join(
        f"WHEN lower(trim({col})) IN ({', '.join(_q(g) for g in groups)}) THEN '{kind}'"
        for table in (A.GROUP_TYPES, A.EXPORT_TYPES) for kind, groups in table.items())
    return f"CASE {whens} END"


def name_case(col: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower(trim({col})), {_q(p)})"
        + (f" AND NOT regexp_matches(lower(trim({col})), {_q(v)})" if v else "") + f" THEN '{kind}'"
        for kind, p, v in A.NAME_RULES)
    return f"CASE {whens} END"


cte("overrides", """SELECT n_nationkey AS ledger_id,
  CASE WHEN n_nationkey % 2 = 0 THEN 'Suspense A/c' ELSE 'Term Loan' END AS account_name,
  CASE WHEN n_nationkey % 2 = 0 THEN 'CURRENT_ASSET' ELSE 'CURRENT_LIABILITY' END AS account_type FROM nation""")
cte("types", f"""SELECT a.ledger_id, a.account_name, a.account_group,
  COALESCE(o.account_type, g, n, 'UNKNOWN') AS account_type,
  CASE WHEN o.account_type IS NOT NULL THEN 'confirmed' WHEN g IS NOT NULL THEN 'group'
       WHEN n IS NOT NULL THEN 'pattern' ELSE 'unknown' END AS source
  FROM (SELECT *, {group_case('account_group')} AS g, {name_case('account_name')} AS n FROM (
    SELECT ledger_id, account_name, max(account_group) AS account_group FROM gl
    WHERE account_name IS NOT NULL AND account_name <> '' GROUP BY 1, 2)) a
  LEFT JOIN overrides o ON a.ledger_id = o.ledger_id AND a.account_name = o.account_name""",
    uses=("gl", "overrides"))
TYPES = ("types",)

register("classify_by_group",
         lambda d: A.accounts_of(d.gl).select(
             "ledger_id", "account_name", "account_group",
             A.classify_by_group(F.col("account_group")).alias("account_type")),
         f"""SELECT ledger_id, account_name, account_group, {group_case('account_group')} AS account_type
         FROM types""", uses=TYPES)
register("classify_by_name",
         lambda d: A.accounts_of(d.gl).select(
             "ledger_id", "account_name", A.classify_by_name(F.col("account_name")).alias("account_type")),
         f"SELECT ledger_id, account_name, COALESCE({name_case('account_name')}, 'UNKNOWN') AS account_type FROM types",
         uses=TYPES)
register("classify_cascade",
         lambda d: A.account_types(d.gl, d.overrides).select(
             "ledger_id", "account_name", "account_type", "source", "confidence", "is_confirmed"),
         """SELECT ledger_id, account_name, account_type, source,
         CAST(CASE WHEN source IN ('confirmed', 'group') THEN 0.95 WHEN source = 'pattern' THEN 0.75 ELSE 0 END
              AS DOUBLE) AS confidence, source = 'confirmed' AS is_confirmed FROM types""", uses=TYPES)
BUCKET = """CASE WHEN account_type IN ('BANK', 'CASH') THEN 'bank'
  WHEN account_type IN ('PAYABLE', 'CURRENT_LIABILITY') THEN 'payable'
  WHEN account_type = 'RECEIVABLE' THEN 'receivable' WHEN account_type = 'TAX' THEN 'tax'
  WHEN account_type = 'INVENTORY' THEN 'inventory' END"""
register("accounts_by_type", lambda d: A.accounts_by_type(A.account_types(d.gl, d.overrides)),
         f"SELECT ledger_id, account_type, {BUCKET} AS bucket, account_name FROM types", uses=TYPES)


# --- issues ------------------------------------------------------------------


def plural(n: str, one: str, many: str) -> str:
    return f"{n} || ' ' || CASE WHEN {n} = 1 THEN '{one}' ELSE '{many}' END"


def issue(code: str, sev: str, cat: str, title: str, n: str, x: str, src: str, detail: str = "NULL") -> str:
    return (f"SELECT ledger_id, '{code}' AS code, {sev} AS severity, '{cat}' AS category, {title} AS title, "
            f"CAST({n} AS BIGINT) AS affected_rows, CAST({x} AS DOUBLE) AS exposure, "
            f"CAST({detail} AS VARCHAR) AS detail FROM {src}")


NET = "debit_amount - credit_amount"


def account_rollup(s: str, e: str, gl: str = "gl") -> str:
    return f"""(SELECT g.ledger_id, g.account_name, max(t.account_type) AS kind, max({e}) AS e,
      COALESCE(SUM({NET}) FILTER (transaction_date BETWEEN {s} AND {e}), 0) AS net,
      COALESCE(SUM(debit_amount + credit_amount) FILTER (transaction_date BETWEEN {s} AND {e}), 0) AS tot,
      COUNT(*) FILTER (transaction_date BETWEEN {s} AND {e}) AS n,
      COALESCE(SUM({NET}) FILTER (transaction_date <= {e}), 0) AS bal,
      MAX(transaction_date) FILTER (transaction_date <= {e}) AS last
      FROM {gl} g LEFT JOIN types t ON g.ledger_id = t.ledger_id AND g.account_name = t.account_name GROUP BY 1, 2)"""


def dup_join(s: str, e: str, gl: str = "gl") -> str:
    t = f"""(SELECT ledger_id, reference_number AS ref, transaction_date AS day,
      COALESCE(party_name, vendor_name, customer_name, account_name) AS party,
      GREATEST(debit_amount, credit_amount) AS amount FROM {gl}
      WHERE transaction_date BETWEEN {s} AND {e} AND GREATEST(debit_amount, credit_amount) > 100
      AND COALESCE(party_name, vendor_name, customer_name, account_name) IS NOT NULL)"""
    return f"""(SELECT a.ledger_id, a.party, a.amount, a.ref AS vch_a, a.day AS date_a, b.ref AS vch_b, b.day AS date_b
      FROM {t} a JOIN {t} b ON a.ledger_id = b.ledger_id AND a.party = b.party AND a.amount = b.amount
      AND a.ref < b.ref AND ABS(b.day - a.day) <= 7)"""


def voucher_rollup(s: str, e: str, gl: str = "gl") -> str:
    a, v = "lower(account_name)", "lower(coalesce(voucher_type, ''))"
    gst = ", ".join(f"SUM(CASE WHEN {a} LIKE '%{t}%' THEN ABS({NET}) ELSE 0 END) AS {t}" for t in ("cgst", "sgst", "igst"))
    return f"""(SELECT ledger_id, reference_number AS ref, MAX(party_name) AS party, SUM(debit_amount) AS dr,
      SUM(credit_amount) AS cr, {gst}, BOOL_OR(coalesce({a}, '') LIKE '%tds%') AS tds,
      BOOL_OR(coalesce({a}, '') LIKE '%creditor%' OR {v} LIKE '%purchase%' OR {v} LIKE '%payment%'
              OR {v} LIKE '%pur%' OR {v} LIKE '%bp%') AS vp
      FROM {gl} WHERE transaction_date BETWEEN {s} AND {e} AND reference_number IS NOT NULL GROUP BY 1, 2)"""


def issue_sql(s: str = S, e: str = E, gl: str = "gl") -> dict[str, str]:
    acct, vch = account_rollup(s, e, gl), voucher_rollup(s, e, gl)
    named = "account_name IS NOT NULL AND account_name <> ''"
    out = {}
    out["trial_balance_mismatch"] = issue(
        "trial_balance_mismatch", "'critical'", "Data Integrity", "'Trial balance is off'", "n", r2("gap"),
        f"(SELECT ledger_id, ABS(SUM(net)) AS gap, COUNT(*) FILTER ({named} AND ABS(net) > 0.01) AS n FROM {acct} "
        "GROUP BY 1) WHERE gap >= 1")
    out["unclassified_accounts"] = issue(
        "unclassified_accounts", "'info'", "Configuration",
        plural("n", "unclassified account", "unclassified accounts"), "n", r2("x"),
        f"(SELECT ledger_id, COUNT(*) AS n, SUM(tot) AS x FROM {acct} WHERE {named} AND n > 0 "
        "AND COALESCE(kind, 'UNKNOWN') = 'UNKNOWN' GROUP BY 1)")
    out["sign_anomalies"] = issue(
        "sign_anomalies", "'review'", "Subledger",
        plural("n", "account with unusual sign", "accounts with unusual sign"), "n", r2("x"),
        f"(SELECT ledger_id, COUNT(*) AS n, SUM(ABS(bal)) AS x FROM {acct} WHERE (kind = 'PAYABLE' AND bal > 100) "
        "OR (kind = 'RECEIVABLE' AND bal < -100) GROUP BY 1)")
    out["debtors_overdue"] = issue(
        "debtors_overdue", "CASE WHEN old THEN 'critical' ELSE 'review' END", "Receivables",
        plural("n", "debtor with no recovery in 60+ days", "debtors with no recovery in 60+ days"), "n", r2("x"),
        f"""(SELECT a.ledger_id, COUNT(*) AS n, SUM(bal) AS x, BOOL_OR(last < a.e - 90) AS old FROM {acct} a
        JOIN (SELECT ledger_id, BOOL_OR(account_type = 'RECEIVABLE') AS mapped FROM types GROUP BY 1) m
        ON a.ledger_id = m.ledger_id
        WHERE CASE WHEN mapped THEN kind = 'RECEIVABLE' ELSE {kw('account_name', ['debtor', 'receivable'])} END
        AND bal > 1000 AND last < a.e - 60 GROUP BY 1)""")
    out["voucher_imbalance"] = issue(
        "voucher_imbalance", "'critical'", "Data Integrity",
        plural("n", "voucher where Debit ≠ Credit", "vouchers where Debit ≠ Credit"), "n", r2("x"),
        f"(SELECT ledger_id, COUNT(*) AS n, SUM(ABS(dr - cr)) AS x FROM {vch} WHERE ABS(dr - cr) > 0.01 GROUP BY 1)")
    out["gst_mismatch"] = issue(
        "gst_mismatch", "'review'", "Indian SME",
        plural("n", "voucher where CGST ≠ SGST", "vouchers where CGST ≠ SGST"), "n", r2("x"),
        f"""(SELECT ledger_id, COUNT(*) AS n, SUM(ABS(cgst - sgst)) AS x FROM {vch}
        WHERE cgst > 0 AND sgst > 0 AND igst = 0 AND ABS(cgst - sgst) > 0.01 GROUP BY 1)""")
    out["tds_potentially_missed"] = issue(
        "tds_potentially_missed", "'review'", "Tax Compliance",
        plural("n", "vendor payment above ₹30,000 with no TDS deducted",
               "vendor payments above ₹30,000 with no TDS deducted"), "n", r2("x"),
        f"""(SELECT ledger_id, COUNT(*) AS n, SUM(GREATEST(dr, cr)) AS x FROM {vch}
        WHERE GREATEST(dr, cr) > 30000 AND party <> '' AND vp AND NOT tds AND ref <> '' GROUP BY 1)""")
    out["duplicate_transactions"] = issue(
        "duplicate_transactions", "'critical'", "Data Integrity",
        plural("n", "possible duplicate transaction", "possible duplicate transactions"), "n", r2("x"),
        f"(SELECT ledger_id, COUNT(*) AS n, SUM(amount) AS x FROM {dup_join(s, e, gl)} GROUP BY 1)")
    out["date_outliers"] = issue(
        "date_outliers", "'review'", "Data Integrity",
        plural("n", "entry dated outside the period", "entries dated outside the period"), "n", r2("x"),
        f"""(SELECT ledger_id, COUNT(*) AS n, SUM(debit_amount + credit_amount) AS x FROM {gl}
        WHERE transaction_date < {s} - 60 OR transaction_date > {e} + 30 GROUP BY 1)""")
    out["missing_fields"] = issue(
        "missing_fields", "'critical'", "Data Integrity",
        plural("n", "entry with missing critical fields", "entries with missing critical fields"), "n", "NULL",
        f"""(SELECT ledger_id, COUNT(*) FILTER (transaction_date IS NULL)
        + COUNT(*) FILTER (debit_amount = 0 AND credit_amount = 0) AS n FROM {gl}
        WHERE transaction_date BETWEEN {s} AND {e} OR transaction_date IS NULL GROUP BY 1) WHERE n > 0""")
    inside = f"transaction_date BETWEEN {s} AND {e}"
    miss = " + ".join(
        f"(CASE WHEN COALESCE(BOOL_OR(lower(voucher_type) LIKE '%{t}%') FILTER ({inside}), FALSE) THEN 0 ELSE 1 END)"
        for t in C.STANDARD_TYPES)
    out["period_completeness"] = issue(
        "period_completeness",
        "CASE WHEN active = 0 OR list_contains(c, 'missing_voucher_types') THEN 'critical' ELSE 'review' END",
        "Period Validity",
        "CASE WHEN active = 0 THEN 'Period has no transactions' WHEN len(c) = 1 THEN 'Period coverage looks off' "
        "ELSE 'Period coverage looks incomplete' END",
        "CASE WHEN active = 0 THEN 0 ELSE len(c) END", "NULL",
        f"""(SELECT *, CASE WHEN active = 0 THEN ['no_transactions'] ELSE list_filter([
          CASE WHEN aw / wd < 0.4 THEN 'low_coverage' END, CASE WHEN miss >= 3 THEN 'missing_voucher_types' END,
          CASE WHEN wd >= 20 AND n / wd < 2 THEN 'very_light_activity' END,
          CASE WHEN span > (e - s) * 1.5 AND span > 90 THEN 'wider_data_range' END], lambda x: x IS NOT NULL) END AS c
        FROM (SELECT ledger_id, max({s}) AS s, max({e}) AS e, {miss} AS miss, COUNT(*) FILTER ({inside}) AS n,
          COUNT(DISTINCT transaction_date) FILTER ({inside}) AS active,
          COUNT(DISTINCT transaction_date) FILTER ({inside} AND isodow(transaction_date) <= 5) AS aw,
          MAX(transaction_date) - MIN(transaction_date) AS span,
          len(list_filter(range(max({s}), max({e}) + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) <= 5)) AS wd
          FROM {gl} GROUP BY 1)) WHERE len(c) > 0""", "array_to_string(c, ',')")
    return out


ISSUES = issue_sql()
NAMES = {
    "chk_trial_balance": "trial_balance_mismatch", "chk_voucher_imbalance": "voucher_imbalance",
    "chk_duplicates": "duplicate_transactions", "chk_date_outliers": "date_outliers",
    "chk_missing_fields": "missing_fields", "chk_unclassified": "unclassified_accounts",
    "chk_gst_mismatch": "gst_mismatch", "chk_sign_anomalies": "sign_anomalies",
    "chk_period_completeness": "period_completeness", "chk_tds_deduction": "tds_potentially_missed",
    "chk_debtors_aging": "debtors_overdue",
}
for _name, _code in NAMES.items():
    register(_name, lambda d, c=_code: C.check(c, d.gl, *d.period, d.overrides), ISSUES[_code], uses=TYPES)

SCAN = "\nUNION ALL ".join(ISSUES[c] for c in C.SCAN_CODES)
cte("issues", SCAN, uses=TYPES)
register("scan", lambda d: C.scan(d.rollups, *d.period, d.overrides), "SELECT * FROM issues", uses=("issues",))
register("scan_totals", lambda d: C.scan_totals(C.run_checks(C.with_period(d.rollups, *d.period), C.SCAN_CODES, d.overrides)),
         """SELECT ledger_id, COUNT(*) AS total_issues, COUNT(*) FILTER (severity = 'critical') AS critical,
         COUNT(*) FILTER (severity = 'review') AS review, COUNT(*) FILTER (severity = 'info') AS info,
         CAST(SUM(CAST(COALESCE(exposure, 0) AS DECIMAL(38,2))) AS DOUBLE) AS total_exposure
         FROM issues GROUP BY 1""", uses=("issues",))
register("dup_pairs", lambda d: C.dup_pairs(C.with_period(d.gl, *d.period)),
         f"""SELECT ledger_id, party, CAST(amount AS DOUBLE) AS amount, vch_a, date_a, vch_b, date_b,
         CAST(ROW_NUMBER() OVER (PARTITION BY ledger_id, party, amount, vch_a, date_a, vch_b, date_b) AS INTEGER) AS copy
         FROM {dup_join(S, E)} QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id
         ORDER BY amount DESC, party, vch_a, date_a, vch_b, date_b) <= 30""")
register("dup_windows", lambda d: W.dup_windows(C.with_period(d.gl, *d.period)),
         f"""WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ledger_id, party, amount ORDER BY day, left(md5(ref), 2), ref) AS slot
           FROM (SELECT ledger_id, reference_number AS ref, transaction_date AS day,
             COALESCE(party_name, vendor_name, customer_name, account_name) AS party, GREATEST(debit_amount, credit_amount) AS amount, COUNT(*) AS n
             FROM gl WHERE transaction_date BETWEEN {S} AND {E} AND GREATEST(debit_amount, credit_amount) > 100 AND reference_number IS NOT NULL
             GROUP BY ALL) WHERE party IS NOT NULL)
         SELECT a.ledger_id, a.party, CAST(a.amount AS DOUBLE) AS amount, a.ref AS vch, a.day AS date, a.n AS copies, a.slot, a.slot + 1 AS first,
           COALESCE(MAX(b.slot), MAX(a.slot)) AS last, CAST(COALESCE(SUM(b.n) FILTER (b.ref <> a.ref), 0) AS BIGINT) AS partners
         FROM r a LEFT JOIN r b ON a.ledger_id = b.ledger_id AND a.party = b.party AND a.amount = b.amount AND b.slot > a.slot AND b.day <= a.day + 7
         GROUP BY ALL""")
register("affected_refs", lambda d: C.affected_refs(d.rollups, *d.period),
         f"""SELECT ledger_id, ref AS reference_number, 'gst_mismatch' AS code FROM {voucher_rollup(S, E)}
           WHERE cgst > 0 AND sgst > 0 AND igst = 0 AND ABS(cgst - sgst) > 0.01
         UNION ALL SELECT ledger_id, ref, 'tds_potentially_missed' FROM {voucher_rollup(S, E)}
           WHERE GREATEST(dr, cr) > 30000 AND party <> '' AND vp AND NOT tds AND ref <> ''
         UNION ALL SELECT ledger_id, ref, 'voucher_imbalance' FROM {voucher_rollup(S, E)} WHERE ABS(dr - cr) > 0.01
         UNION ALL (SELECT ledger_id, vch_a, 'duplicate_transactions' FROM {dup_join(S, E)}
           UNION SELECT ledger_id, vch_b, 'duplicate_transactions' FROM {dup_join(S, E)})""")
register("scan_examples", lambda d: C.scan_examples(d.rollups, *d.period, d.overrides),
         f"""SELECT ledger_id, code, what, {r2('size')} AS size FROM (
         SELECT ledger_id, 'trial_balance_mismatch' AS code, account_name AS what, ABS(net) AS size
           FROM {account_rollup(S, E)} WHERE account_name <> '' AND ABS(net) > 0.01
         UNION ALL SELECT ledger_id, 'unclassified_accounts', account_name, tot FROM {account_rollup(S, E)}
           WHERE account_name <> '' AND n > 0 AND COALESCE(kind, 'UNKNOWN') = 'UNKNOWN'
         UNION ALL SELECT ledger_id, 'sign_anomalies', account_name, ABS(bal) FROM {account_rollup(S, E)}
           WHERE (kind = 'PAYABLE' AND bal > 100) OR (kind = 'RECEIVABLE' AND bal < -100)
         UNION ALL SELECT ledger_id, 'gst_mismatch', ref, ABS(cgst - sgst) FROM {voucher_rollup(S, E)}
           WHERE cgst > 0 AND sgst > 0 AND igst = 0 AND ABS(cgst - sgst) > 0.01
         UNION ALL SELECT ledger_id, 'tds_potentially_missed', ref, GREATEST(dr, cr) FROM {voucher_rollup(S, E)}
           WHERE GREATEST(dr, cr) > 30000 AND party <> '' AND vp AND NOT tds AND ref <> '')
         QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id, code ORDER BY size DESC, what) <= 5""", uses=TYPES)
register("chk_negative_bank", lambda d: C.negative_bank(d.gl),
         f"""SELECT ledger_id, lower(account_name) AS account_name, {r2(f'SUM({NET})')} AS balance FROM gl
         WHERE {kw('account_name', ['bank', 'cash'])} GROUP BY 1, 2 HAVING SUM({NET}) < -1""")
register("chk_date_outliers_pct", lambda d: C.date_outliers_pct(d.gl),
         """WITH b AS (SELECT ledger_id, COUNT(*) AS n, list_sort(list(transaction_date)) AS l FROM gl
           WHERE transaction_date IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 20),
         c AS (SELECT ledger_id, l[CAST(FLOOR(n * 0.05) AS INTEGER) + 1] - 30 AS lo,
           l[CAST(FLOOR(n * 0.95) AS INTEGER) + 1] + 30 AS hi FROM b)
         SELECT c.ledger_id, lo AS earliest, hi AS latest,
           COUNT(*) FILTER (transaction_date < lo OR transaction_date > hi) AS outliers
         FROM gl JOIN c USING (ledger_id) WHERE transaction_date IS NOT NULL GROUP BY 1, 2, 3""")
register("company_profile", lambda d: C.company_profile(d.gl, d.overrides), f"""
  WITH v AS (SELECT ledger_id, reference_number, SUM(debit_amount) AS dr, SUM(credit_amount) AS cr FROM gl
    WHERE reference_number <> '' GROUP BY 1, 2),
  vs AS (SELECT ledger_id, COUNT(*) AS vouchers, COUNT(*) FILTER (ABS(dr - cr) > 0.01) AS imbalanced_vouchers,
    {r2('COALESCE(SUM(ABS(dr - cr)) FILTER (ABS(dr - cr) > 0.01), 0)')} AS imbalance_exposure,
    {r2('SUM(dr)')} AS total_debit, {r2('SUM(cr)')} AS total_credit FROM v GROUP BY 1),
  a AS (SELECT ledger_id, COUNT(*) AS accounts, COUNT(*) FILTER (account_type = 'UNKNOWN') AS unclassified,
    COUNT(DISTINCT account_type) FILTER (account_type IN ('BANK', 'PAYABLE', 'RECEIVABLE', 'TAX', 'INVENTORY'))
    AS recon_categories FROM types GROUP BY 1),
  d AS (SELECT ledger_id, CAST(SUM(n - 1) AS BIGINT) AS duplicates FROM (SELECT ledger_id, COUNT(*) AS n FROM gl
    WHERE transaction_date IS NOT NULL AND party_name <> '' AND (debit_amount <> 0 OR credit_amount <> 0)
    GROUP BY ledger_id, transaction_date, party_name, CASE WHEN debit_amount <> 0 THEN debit_amount ELSE credit_amount END)
    GROUP BY 1),
  p AS (SELECT ledger_id, COUNT(DISTINCT party_name) AS parties FROM gl GROUP BY 1),
  r AS (SELECT ledger_id, COUNT(*) AS entries, COUNT(*) FILTER (COALESCE(account_name, '') = ''
    OR (debit_amount = 0 AND credit_amount = 0)) AS missing_fields FROM gl GROUP BY 1),
  b AS (SELECT ledger_id, COUNT(*) AS negative_banks FROM (SELECT ledger_id, lower(account_name) FROM gl
    WHERE {kw('account_name', ['bank', 'cash'])} GROUP BY 1, 2 HAVING SUM({NET}) < -1) GROUP BY 1)
  SELECT r.*, vs.* EXCLUDE (ledger_id), a.* EXCLUDE (ledger_id), parties, COALESCE(duplicates, 0) AS duplicates,
    COALESCE(negative_banks, 0) AS negative_banks
  FROM r LEFT JOIN vs USING (ledger_id) LEFT JOIN a USING (ledger_id) LEFT JOIN p USING (ledger_id)
  LEFT JOIN d USING (ledger_id) LEFT JOIN b USING (ledger_id)""", uses=TYPES)

# --- across ledgers ------------------------------------------------------------

cte("glp", """SELECT gl.*, m.d - 90 AS ps, m.d AS pe FROM gl JOIN
  (SELECT ledger_id, MAX(transaction_date) AS d FROM gl GROUP BY 1) m USING (ledger_id)""", uses=("gl",))
_recent = issue_sql("ps", "pe", "glp")
cte("recent", "\nUNION ALL ".join(_recent[c] for c in C.SCAN_CODES), uses=("glp", "types"))
register("scan_summary", lambda d: C.scan_summary(C.recent_issues(d.rollups, d.overrides)),
         """SELECT code, CAST(SUM(affected_rows) AS BIGINT) AS affected_rows, COUNT(*) AS cards,
         CAST(SUM(CAST(COALESCE(exposure, 0) AS DECIMAL(38,2))) AS DOUBLE) AS exposure FROM recent GROUP BY 1
         ORDER BY exposure DESC, code LIMIT 5""", uses=("recent",))
_rate = "CASE code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.MANUAL_MINUTES.items()) + " ELSE 0 END"
register("time_saved", lambda d: C.time_saved(C.recent_issues(d.rollups, d.overrides), d.rollups.ledgers()),
         f"""SELECT ledger_id, CAST(ROUND(GREATEST(0, CAST(COALESCE(h, 0) AS DOUBLE) + 210
           - (COALESCE(n, 0) * 2.0 + 10)) / 60, 4) AS DOUBLE) AS hours_saved
         FROM (SELECT DISTINCT ledger_id FROM gl) LEFT JOIN (SELECT ledger_id, SUM(affected_rows * {_rate}) AS h,
           COUNT(*) AS n FROM recent GROUP BY 1) USING (ledger_id)""", uses=("recent",))
