"""Named queries for the canned reports with their reference SQL."""

from __future__ import annotations

from ..operators import reports
from ..sources.trade_ledger import AS_OF
from .registry import cte, register

AS = f"DATE '{AS_OF}'"
VENDOR, CUSTOMER = "vendor_party", "customer_party"
# the ledger with the party column each ledger uses: the specific one where any row fills it
cte("gl_parties", """SELECT gl.*,
    CASE WHEN has_vendor THEN vendor_name WHEN has_party THEN party_name ELSE account_name END AS vendor_party,
    CASE WHEN has_customer THEN customer_name WHEN has_party THEN party_name ELSE account_name END AS customer_party
    FROM gl JOIN (SELECT ledger_id, BOOL_OR(vendor_name IS NOT NULL) AS has_vendor,
                         BOOL_OR(customer_name IS NOT NULL) AS has_customer,
                         BOOL_OR(party_name IS NOT NULL) AS has_party FROM gl GROUP BY 1) USING (ledger_id)""", ("gl",))
CAT = "COALESCE(account_group, 'Unclassified')"
MTH = "strftime(transaction_date, '%Y-%m')"
DRS, CRS = "SUM(debit_amount)", "SUM(credit_amount)"
Q0, Q1 = "DATE '2001-04-01'", "DATE '2001-07-01'"


def r2(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DOUBLE)"


def half_up(num: str, den: str) -> str:
    """num/den hundredths, rounded half away from zero in whole numbers (as decimals do)."""
    return f"CAST(SIGN({num}) * ((2 * ABS({num}) + {den}) // (2 * {den})) AS DOUBLE) / 100"


def kw(cols: str | list[str], words: list[str]) -> str:
    cols = [cols] if isinstance(cols, str) else cols
    return "(" + " OR ".join(f"LOWER(COALESCE({c}, '')) LIKE '%{w}%'" for c in cols for w in words) + ")"


def when(cond: str, x: str) -> str:
    return f"SUM(CASE WHEN {cond} THEN {x} ELSE 0 END)"


def topk(inner: str, order: str, k: int) -> str:
    return (f"SELECT * FROM ({inner}) q QUALIFY ROW_NUMBER() OVER "
            f"(PARTITION BY ledger_id ORDER BY {order}) <= {k}")


def rows(cond: str, cols: str, table: str = "gl") -> str:
    return f"SELECT ledger_id, row_id, transaction_date, {cols} FROM {table} WHERE {cond}"


ACCT, DESC, VT, GRP = "account_name", "description", "voucher_type", "account_group"
SIDES = f"{r2('debit_amount')} AS debit, {r2('credit_amount')} AS credit"
VCH = f"reference_number AS voucher_no, account_name AS account, description AS narration, {SIDES}"
HAS_DATE = "transaction_date IS NOT NULL"
AGE = f"({AS} - transaction_date)"
NET = "debit_amount - credit_amount"


def _bal(key: str, alias: str, expr: str, table: str = "gl") -> str:
    return (f"SELECT ledger_id, {key} AS {alias}, {r2(expr)} AS outstanding FROM {table} "
            f"GROUP BY 1, 2 HAVING {expr} > 0")


def _cc(value: str, alias: str, counted: bool) -> str:
    n = "COUNT(*) AS transactions, " if counted else ""
    return (f"SELECT ledger_id, cost_centre, {n}{r2(value)} AS {alias} FROM gl "
            "WHERE cost_centre IS NOT NULL GROUP BY 1, 2")


CURRENT = (f"SELECT ledger_id, {when(kw(GRP, ['current asset']), f'COALESCE(closing_balance, {NET})')} AS a, "
           f"{when(kw(GRP, ['current liabilit']), f'ABS(COALESCE(closing_balance, {NET}))')} AS b FROM gl GROUP BY 1")
SIZE = "ABS(COALESCE(closing_balance, debit_amount))"
GST = f"{HAS_DATE} AND {kw([ACCT, DESC], ['gst'])}"

SQL = {
    "ap_aging": _bal(ACCT, "account_name", f"{DRS} - {CRS}"),
    "ar_aging": _bal(ACCT, "account_name", f"{CRS} - {DRS}"),
    "top_vendors": topk(f"SELECT ledger_id, account_name, {r2(DRS)} AS total_spend FROM gl GROUP BY 1, 2",
                        "total_spend DESC NULLS LAST, account_name", 10),
    "monthly_summary": f"""SELECT ledger_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
        {r2(DRS)} AS total_debits, {r2(CRS)} AS total_credits FROM gl GROUP BY 1, 2""",
    "cost_centre_breakdown": _cc(DRS, "total", False),
    "cost_centre_revenue": _cc(CRS, "revenue", True),
    "cost_centre_expenses": _cc(DRS, "expenses", True),
    "cash_balance": f"""SELECT ledger_id, account_name,
        {r2(f"COALESCE(MAX(closing_balance), SUM(credit_amount - debit_amount))")} AS balance
        FROM gl WHERE {kw(ACCT, ['cash', 'bank'])} OR ({kw(ACCT, ['savings'])} AND closing_balance IS NOT NULL)
        GROUP BY 1, 2 HAVING MAX(closing_balance) IS NOT NULL OR ROUND({CRS} - {DRS}, 2) > 0""",
    "overdue_debtors_30_60_90": f"""SELECT ledger_id, COALESCE({CUSTOMER}, 'Unknown') AS customer,
        {r2(when(f"{AGE} BETWEEN 0 AND 30", NET))} AS "0_30_days",
        {r2(when(f"{AGE} BETWEEN 31 AND 60", NET))} AS "31_60_days",
        {r2(when(f"{AGE} BETWEEN 61 AND 90", NET))} AS "61_90_days",
        {r2(when(f"{AGE} > 90", NET))} AS over_90_days,
        {r2(f"SUM({NET})")} AS total_outstanding
        FROM gl_parties WHERE {HAS_DATE} GROUP BY 1, 2 HAVING ROUND(SUM({NET}), 2) > 0""",
    "gst_summary": f"""SELECT ledger_id, {MTH} AS month,
        {r2(when(kw([ACCT, DESC], ['cgst']), 'net_amount'))} AS cgst,
        {r2(when(kw([ACCT, DESC], ['sgst']), 'net_amount'))} AS sgst,
        {r2(when(kw([ACCT, DESC], ['igst']), 'net_amount'))} AS igst,
        {r2("SUM(net_amount)")} AS total_gst FROM gl WHERE {GST} GROUP BY 1, 2""",
    "vendor_ledger": f"""SELECT ledger_id, {VENDOR} AS vendor, COUNT(*) AS transactions,
        {r2(DRS)} AS total_purchases, {r2(CRS)} AS total_paid, {r2(f"{DRS} - {CRS}")} AS outstanding
        FROM gl_parties WHERE {VENDOR} IS NOT NULL GROUP BY 1, 2""",
    "customer_ledger": f"""SELECT ledger_id, {CUSTOMER} AS customer, COUNT(*) AS transactions,
        {r2(CRS)} AS total_sales, {r2(DRS)} AS total_received, {r2(f"{CRS} - {DRS}")} AS outstanding
        FROM gl_parties WHERE {CUSTOMER} IS NOT NULL GROUP BY 1, 2""",
    "creditors_top_10": topk(_bal(VENDOR, "creditor", f"ROUND({DRS} - {CRS}, 2)", f"gl_parties WHERE {VENDOR} IS NOT NULL"), "outstanding DESC, creditor", 10),
    "debtors_top_10": topk(_bal(CUSTOMER, "debtor", f"ROUND({CRS} - {DRS}, 2)", f"gl_parties WHERE {CUSTOMER} IS NOT NULL"), "outstanding DESC, debtor", 10),
    "top_customers": topk(f"""SELECT ledger_id, {CUSTOMER} AS customer, COUNT(*) AS transactions,
        {r2(CRS)} AS total_revenue FROM gl_parties WHERE {CUSTOMER} IS NOT NULL GROUP BY 1, 2""",
                          "total_revenue DESC, customer", 10),
    "purchase_register": rows(f"{kw(VT, ['purchase', 'bill'])} OR {VENDOR} IS NOT NULL",
                              f"COALESCE({VENDOR}, 'Unknown') AS vendor, reference_number AS bill_no, description AS narration, "
                              f"{r2('debit_amount')} AS amount", "gl_parties"),
    "sales_register": rows(f"{kw(VT, ['sales', 'invoice'])} OR {CUSTOMER} IS NOT NULL",
                           f"COALESCE({CUSTOMER}, 'Unknown') AS customer, reference_number AS invoice_no, description AS narration, "
                           f"{r2('credit_amount')} AS amount", "gl_parties"),
    "payroll_summary": f"""SELECT ledger_id, {MTH} AS month,
        COUNT(DISTINCT COALESCE(party_name, account_name, 'Unknown')) AS employees, {r2(DRS)} AS total_salary
        FROM gl WHERE {kw(ACCT, ['salary', 'payroll', 'wages', 'remuneration', 'staff'])}
        OR {kw(VT, ['payroll'])} OR {kw(DESC, ['salary', 'payroll', 'wages'])} GROUP BY 1, 2""",
    "profit_loss_summary": f"""SELECT ledger_id, account_group AS category, {r2(CRS)} AS total_income,
        {r2(DRS)} AS total_expense, {r2(f"{CRS} - {DRS}")} AS net
        FROM gl WHERE account_group IS NOT NULL GROUP BY 1, 2""",
    "balance_sheet_snapshot": f"""SELECT ledger_id, account_group AS category,
        {r2(f"COALESCE(SUM(closing_balance), SUM({NET}))")} AS balance FROM gl
        WHERE account_group IS NOT NULL
        AND {kw(GRP, ['asset', 'liabilit', 'equity', 'capital', 'loan', 'reserve'])} GROUP BY 1, 2""",
    "expense_by_voucher_type": f"""SELECT ledger_id, voucher_type AS type, COUNT(*) AS transactions,
        {r2(DRS)} AS total_amount FROM gl WHERE voucher_type IS NOT NULL GROUP BY 1, 2""",
    "tds_summary": f"""SELECT ledger_id, {MTH} AS month,
        COALESCE(party_name, vendor_name, account_name, 'Unknown') AS deductee, {r2('SUM(CASE WHEN debit_amount <> 0 THEN debit_amount WHEN credit_amount <> 0 THEN credit_amount ELSE COALESCE(net_amount, 0) END)')} AS tds_amount
        FROM gl WHERE {kw([ACCT, DESC, GRP], ['tds'])} GROUP BY 1, 2, 3""",
    "bank_reconciliation": f"""SELECT ledger_id, account_name AS bank_account, COUNT(*) AS entries,
        {r2(CRS)} AS total_credits, {r2(DRS)} AS total_debits, {r2(f"{CRS} - {DRS}")} AS net_balance FROM gl
        WHERE {kw(ACCT, ['bank', 'savings', 'current account', 'hdfc', 'icici', 'sbi', 'axis'])} GROUP BY 1, 2""",
    "advance_payments_outstanding": f"""SELECT ledger_id,
        COALESCE(vendor_name, customer_name, party_name, account_name, 'Unknown') AS party,
        COUNT(*) AS count, {r2(DRS)} AS total_advance FROM gl WHERE {kw([ACCT, DESC, VT], ['advance'])}
        GROUP BY 1, 2 HAVING ROUND({DRS}, 2) > 0""",
    "sales_last_quarter": f"""SELECT ledger_id, {MTH} AS month, COALESCE({CUSTOMER}, 'Unknown') AS customer,
        {r2(CRS)} AS sales FROM gl_parties WHERE transaction_date >= {Q0} AND transaction_date < {Q1}
        AND ({kw(VT, ['sales', 'invoice'])} OR {CUSTOMER} IS NOT NULL) GROUP BY 1, 2, 3""",
    "expenses_last_quarter": f"""SELECT ledger_id, {MTH} AS month, {CAT} AS category, {r2(DRS)} AS expenses
        FROM gl WHERE transaction_date >= {Q0} AND transaction_date < {Q1} GROUP BY 1, 2, 3""",
    "cash_flow_monthly": f"""SELECT ledger_id, {MTH} AS month, {r2(CRS)} AS inflows, {r2(DRS)} AS outflows,
        {r2(f"{CRS} - {DRS}")} AS net_cash_flow FROM gl
        WHERE {HAS_DATE} AND {kw(ACCT, ['cash', 'bank'])} GROUP BY 1, 2""",
    "yoy_comparison_monthly": f"""SELECT ledger_id, strftime(transaction_date, '%m') AS month,
        {r2(when("year(transaction_date) = 2001", "credit_amount"))} AS current_year,
        {r2(when("year(transaction_date) = 2000", "credit_amount"))} AS previous_year,
        {r2(when("year(transaction_date) = 2001", "credit_amount") + " - "
            + when("year(transaction_date) = 2000", "credit_amount"))} AS yoy_growth
        FROM gl WHERE year(transaction_date) IN (2000, 2001) GROUP BY 1, 2""",
    "gst_input_vs_output": f"""SELECT ledger_id, {MTH} AS month,
        {r2(when(f"{kw(ACCT, ['input'])} OR {kw(DESC, ['input%gst'])}", "debit_amount"))} AS input_gst,
        {r2(when(f"{kw(ACCT, ['output'])} OR {kw(DESC, ['output%gst'])}", "credit_amount"))} AS output_gst,
        {r2(when(kw(ACCT, ['output']), "credit_amount") + " - " + when(kw(ACCT, ['input']), "debit_amount"))}
        AS net_gst_payable FROM gl WHERE {GST} GROUP BY 1, 2""",
    "zero_balance_accounts": f"""SELECT ledger_id, account_name, COALESCE(account_group, 'Unknown') AS category,
        {r2(f"COALESCE(MAX(closing_balance), SUM({NET}))")} AS balance FROM gl WHERE account_name IS NOT NULL
        GROUP BY 1, 2, 3 HAVING ABS(ROUND(COALESCE(MAX(closing_balance), SUM({NET})), 2)) < 0.01""",
    "journal_entries": rows(f"{kw(VT, ['journal', 'jv'])} OR {kw(DESC, ['journal'])}", VCH),
    "contra_entries": rows(f"{kw(VT, ['contra'])} OR ({kw(ACCT, ['cash'])} AND {kw(DESC, ['bank'])}) "
                           f"OR ({kw(ACCT, ['bank'])} AND {kw(DESC, ['cash'])})", VCH),
    "provisions": rows(kw([ACCT, DESC, GRP], ["provision"]),
                       f"account_name AS account, account_group, description AS narration, {SIDES}"),
    "write_offs": rows(kw([ACCT, DESC], ["write%off", "bad debt", "written off"]),
                       f"account_name AS account, description AS narration, {SIDES}"),
    "intercompany_transactions": rows(
        f"{kw(ACCT, ['intercompany', 'inter company', 'related party', 'group company', 'subsidiary', 'holding'])}"
        f" OR {kw(DESC, ['intercompany', 'related party', 'group company'])}",
        f"account_name AS entity, description AS narration, {SIDES}"),
    "large_transactions": rows(
        "GREATEST(debit_amount, credit_amount, ABS(net_amount)) >= 100000",
        "account_name AS account, reference_number AS reference, description AS narration, "
        f"{r2('GREATEST(debit_amount, credit_amount, ABS(net_amount))')} AS amount"),
    "pending_bills": f"""SELECT ledger_id, row_id, COALESCE({VENDOR}, 'Unknown') AS vendor, reference_number AS bill_no,
        transaction_date, due_date, CAST({AS} - due_date AS INTEGER) AS days_overdue, {r2('debit_amount')} AS amount
        FROM gl_parties WHERE {kw(VT, ['purchase', 'invoice', 'bill'])} AND due_date < {AS}""",
    "multi_currency_summary": f"""SELECT ledger_id, COALESCE(currency_code, 'INR') AS currency,
        COUNT(*) AS transactions, {r2(DRS)} AS total_debits, {r2(CRS)} AS total_credits FROM gl GROUP BY 1, 2""",
    "unrealized_gains_losses": f"""SELECT ledger_id, COALESCE(currency_code, 'INR') AS currency,
        account_name AS account, {r2(DRS)} AS total_debit, {r2(CRS)} AS total_credit,
        {r2(f"{CRS} - {DRS}")} AS net_position FROM gl
        WHERE {kw(ACCT, ['forex', 'exchange', 'fx ', 'foreign'])}
        OR {kw(DESC, ['unrealized', 'exchange gain', 'exchange loss', 'forex'])}
        OR COALESCE(currency_code, 'INR') <> 'INR' GROUP BY 1, 2, 3""",
    "current_ratio": f"""SELECT ledger_id, {r2('a')} AS current_assets, {r2('b')} AS current_liabilities,
        ROUND(CAST(a AS DOUBLE) / NULLIF(CAST(b AS DOUBLE), 0), 2) AS current_ratio FROM ({CURRENT})""",
    "working_capital": f"""SELECT ledger_id, {r2('a')} AS current_assets, {r2('b')} AS current_liabilities,
        {r2('a - b')} AS working_capital FROM ({CURRENT})""",
    "debt_equity_ratio": f"""SELECT ledger_id, {r2('d')} AS total_debt, {r2('e')} AS total_equity,
        ROUND(CAST(d0 AS DOUBLE) / NULLIF(CAST(e0 AS DOUBLE), 0), 2) AS debt_equity_ratio FROM (
        SELECT ledger_id, {when(kw(GRP, ['loan', 'borrowing', 'debt', 'term loan']), SIZE)} AS d,
        {when(kw(GRP, ['equity', 'capital', 'reserve', 'surplus']), SIZE)} AS e,
        {when(kw(GRP, ['loan', 'borrowing', 'debt']), SIZE)} AS d0,
        {when(kw(GRP, ['equity', 'capital', 'reserve']), SIZE)} AS e0 FROM gl GROUP BY 1)""",
    "budget_variance": f"""WITH monthly AS (SELECT ledger_id, {MTH} AS month, {CAT} AS category,
        CAST(ROUND({DRS}, 2) * 100 AS HUGEINT) AS p FROM gl WHERE {HAS_DATE} GROUP BY 1, 2, 3),
        w AS (SELECT *, CAST(SUM(p) OVER c AS HUGEINT) AS s, COUNT(*) OVER c AS n
              FROM monthly WINDOW c AS (PARTITION BY ledger_id, category))
        SELECT ledger_id, month, category, CAST(p AS DOUBLE) / 100 AS actual,
        {half_up('s', 'n')} AS avg_monthly, {half_up('(p * n - s)', 'n')} AS variance_from_avg FROM w""",
    "forecast_vs_actual": f"""WITH monthly AS (SELECT ledger_id, {MTH} AS month, CAST(ROUND({CRS}, 2) AS DECIMAL(18,2)) AS actual
        FROM gl WHERE {HAS_DATE} GROUP BY 1, 2)
        SELECT ledger_id, month, CAST(actual AS DOUBLE) AS actual_revenue,
        {r2("LAG(actual) OVER w * 1.05")} AS forecast_5pct_growth,
        {r2("actual - COALESCE(LAG(actual) OVER w * 1.05, actual)")} AS variance
        FROM monthly WINDOW w AS (PARTITION BY ledger_id ORDER BY month)""",
    "fixed_asset_summary": f"""SELECT ledger_id, account_name AS asset,
        COALESCE(account_group, 'Fixed Asset') AS category, {r2(DRS)} AS gross_value,
        {r2(CRS)} AS accumulated_depreciation, {r2(f"{DRS} - {CRS}")} AS net_book_value FROM gl
        WHERE {kw("COALESCE(account_group, account_name)", reports.ASSET_GROUPS)} GROUP BY 1, 2, 3""",
    "depreciation_schedule": f"""SELECT ledger_id, {MTH} AS month, account_name AS asset,
        {r2(DRS)} AS depreciation_amount FROM gl WHERE {kw([ACCT, GRP, DESC], ['depreciation'])} GROUP BY 1, 2, 3""",
    "vendor_payment_summary": f"""SELECT ledger_id, COALESCE({VENDOR}, 'Unknown') AS vendor, {MTH} AS month, COUNT(*) AS payments,
        {r2(CRS)} AS total_paid FROM gl_parties WHERE {HAS_DATE} AND ({kw(VT, ['payment'])} OR {VENDOR} IS NOT NULL) GROUP BY 1, 2, 3""",
    "customer_receipts_summary": f"""SELECT ledger_id, COALESCE({CUSTOMER}, 'Unknown') AS customer, {MTH} AS month,
        COUNT(*) AS receipts, {r2(DRS)} AS total_received FROM gl_parties WHERE {HAS_DATE} AND ({kw(VT, ['receipt'])} OR {CUSTOMER} IS NOT NULL) GROUP BY 1, 2, 3""",
    "account_monthly_drill": f"""SELECT ledger_id, account_name, {MTH} AS month, {r2(DRS)} AS debits,
        {r2(CRS)} AS credits, {r2(f"{CRS} - {DRS}")} AS net FROM gl
        WHERE {HAS_DATE} AND account_name IS NOT NULL GROUP BY 1, 2, 3""",
    "period_close_summary": f"""SELECT ledger_id, {MTH} AS period, {CAT} AS category, COUNT(*) AS entries,
        {r2(DRS)} AS total_debits, {r2(CRS)} AS total_credits, {r2(f"{CRS} - {DRS}")} AS net
        FROM gl WHERE {HAS_DATE} GROUP BY 1, 2, 3""",
}

assert set(SQL) == set(reports.REPORTS), set(SQL) ^ set(reports.REPORTS)

for _name in reports.REPORTS:
    register(_name, lambda d, n=_name: reports.report(n, d.gl, d.as_of, ordered=False, parties=d.parties), SQL[_name],
             uses=("gl_parties",) if _name in reports.PARTY_REPORTS else ("gl",))

register(
    "dashboard_cards",
    lambda d: reports.dashboard_cards(d.gl, d.as_of, d.parties),
    "\nUNION ALL ".join(
        f"SELECT ledger_id, {i} AS position, '{title}' AS title, {label} AS label, {value} AS value FROM ({SQL[n]})"
        for i, (n, title, label, value) in enumerate(reports.PINNED)),
    uses=("gl_parties",),
)
