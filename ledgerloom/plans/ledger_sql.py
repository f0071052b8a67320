"""Reference SQL for the derived ledger: one SELECT per voucher leg."""

from __future__ import annotations

from ..sources.trade_ledger import JOURNAL_ACCOUNTS, SALES_NARRATIONS
from .registry import cte

COLUMNS = [
    "ledger_id", "row_id", "transaction_date", "due_date", "account_name", "account_group",
    "vendor_name", "customer_name", "party_name", "description", "reference_number",
    "voucher_type", "cost_centre", "currency_code", "debit_amount", "credit_amount",
    "closing_balance", "excluded",
]


def _q(v: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"


def _case(key: str, values: list[str | None], default: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {key} {whens} ELSE {default} END"


def _leg(table: str, **given: str) -> str:
    defaults = {
        "due_date": "CAST(NULL AS DATE)", "vendor_name": "CAST(NULL AS VARCHAR)",
        "customer_name": "CAST(NULL AS VARCHAR)", "party_name": "CAST(NULL AS VARCHAR)",
        "cost_centre": "CAST(NULL AS VARCHAR)", "currency_code": "CAST(NULL AS VARCHAR)",
        "debit_amount": "0", "credit_amount": "0",
        "closing_balance": "NULL", "excluded": "FALSE",
    }
    vals = {**defaults, **given}
    pos = vals.pop("pos")
    vals["row_id"] = f"{vals['reference_number']} || '/{pos}'"
    for c in ("debit_amount", "credit_amount", "closing_balance"):
        vals[c] = f"CAST({vals[c]} AS DECIMAL(20,4))"
    return "SELECT " + ", ".join(f"{vals[c]} AS {c}" for c in COLUMNS) + f" FROM {table}"


def _sales() -> list[str]:
    out = []
    tax = "ROUND(price * 0.09, 2)"
    bare = "CASE WHEN k % 107 = 11 THEN {} ELSE {} END"
    for prefix, suffix, shift, cond in (("INV-", "''", 0, "TRUE"), ("INV-", "'-DUP'", 3, "k % 83 = 2")):
        zero = "CASE WHEN k % 73 = 4 THEN 0 ELSE {} END"
        common = dict(
            ledger_id="c_nationkey", reference_number=f"'{prefix}' || k || {suffix}",
            transaction_date=f"CASE WHEN k % 79 = 3 THEN NULL ELSE day + {shift} END",
            description=_case("k % 43", SALES_NARRATIONS, "'Invoice to ' || c_name"),
            voucher_type="'Sales'", cost_centre="o_orderpriority",
            currency_code="CASE WHEN c_mktsegment = 'MACHINERY' THEN 'USD' ELSE 'INR' END",
            excluded="k % 67 = 6",
        )
        who = "CASE WHEN k % 103 = 5 THEN NULL ELSE c_name END"
        t = f"so WHERE {cond}"
        out += [
            _leg(t, pos="1", account_name="'Sundry Debtors'", account_group="'Sundry Debtors'",
                 customer_name=who, party_name=who,
                 debit_amount=zero.format(f"price + 2 * {tax} + CASE WHEN k % 97 = 0 THEN 50 ELSE 0 END"), **common),
            _leg(t, pos="2", account_name="'Sales - ' || c_mktsegment", account_group="'Sales Accounts'",
                 credit_amount=zero.format("price"), **common),
            _leg(t, pos="3", account_name=bare.format("'Freight Outward'", "'CGST Output @9%'"),
                 account_group=bare.format("'Indirect Expenses'", "'Duties & Taxes'"),
                 credit_amount=zero.format(
                     f"CASE WHEN k % 89 = 1 THEN ROUND({tax} * 1.07, 2) ELSE {tax} END"), **common),
            _leg(t, pos="4", account_name=bare.format("'Freight Outward'", "'SGST Output @9%'"),
                 account_group=bare.format("'Indirect Expenses'", "'Duties & Taxes'"),
                 debit_amount=zero.format(f"CASE WHEN k % 113 = 17 THEN {tax} ELSE 0 END"),
                 credit_amount=zero.format(f"CASE WHEN k % 113 = 17 THEN 0 ELSE {tax} END"), **common),
        ]
    common = dict(ledger_id="c_nationkey", reference_number="'BR-' || k", transaction_date="day + 30",
                  description="CASE WHEN k % 43 = 5 THEN 'Cash deposited in bank' ELSE 'Receipt from customer' END",
                  voucher_type="'Receipt'")
    t = "so WHERE o_orderstatus = 'F'"
    out += [
        _leg(t, pos="1", account_name="'HDFC Bank A/c'", account_group="'Bank Accounts'",
             debit_amount="price", **common),
        _leg(t, pos="2", account_name="'Sundry Debtors'", account_group="'Sundry Debtors'",
             customer_name=who, party_name=who, credit_amount="price - CASE WHEN k % 109 = 13 THEN 10 ELSE 0 END",
             **common),
    ]
    return out


def _purchases() -> list[str]:
    tax = "ROUND(ext * 0.09, 2)"
    tds = "CASE WHEN l_suppkey % 3 = 0 THEN ROUND(ext * 0.02, 2) ELSE 0 END"
    tail = "k || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
    who = "CASE WHEN k % 101 = 7 THEN NULL ELSE s_name END"
    base = dict(ledger_id="s_nationkey")
    pur = dict(base, reference_number=f"'PUR-' || {tail}", transaction_date="day", due_date="day + 30",
               description="'Goods purchased'", voucher_type="'Purchase'", cost_centre="p_type",
               currency_code="'INR'")
    pay = dict(base, reference_number=f"'BP-' || {tail}", transaction_date="day + 45",
               description="'Payment to supplier'", voucher_type="'Payment'")
    jv = dict(base, reference_number=f"'JV-' || {tail}", transaction_date="day",
              description="'Journal adjustment'", voucher_type="'Journal'")
    paid, journal = "li WHERE l_returnflag = 'R'", "li WHERE l_linenumber >= 6"
    return [
        _leg("li", pos="1", account_name="'Purchase - ' || p_brand", account_group="'Purchase Accounts'",
             debit_amount="ext", **pur),
        _leg("li", pos="2", account_name="'CGST Input @9%'", account_group="'Duties & Taxes'",
             debit_amount=tax, **pur),
        _leg("li", pos="3", account_name="'SGST Input @9%'", account_group="'Duties & Taxes'",
             debit_amount=tax, **pur),
        _leg("li", pos="4", account_name="'Sundry Creditors'", account_group="'Sundry Creditors'",
             vendor_name=who, party_name=who, credit_amount=f"ext + 2 * {tax}", **pur),
        _leg(paid, pos="1", account_name="'Sundry Creditors'", account_group="'Sundry Creditors'",
             vendor_name=who, party_name=who, debit_amount="ext", **pay),
        _leg(paid, pos="2",
             account_name="CASE WHEN l_linestatus = 'O' THEN 'HDFC Bank A/c' ELSE 'ICICI Bank A/c' END",
             account_group="'Bank Accounts'", credit_amount=f"ext - {tds}", **pay),
        _leg(paid + " AND l_suppkey % 3 = 0", pos="3", account_name="'TDS Payable'",
             account_group="'Duties & Taxes'", vendor_name="s_name", party_name="s_name",
             credit_amount=tds, **pay),
        _leg(journal, pos="1", account_name=_case("k % 14", [a for a, _ in JOURNAL_ACCOUNTS], "NULL")
             + " || CASE WHEN k % 14 = 13 THEN ' ' || year(day) ELSE '' END",
             account_group=_case("k % 14", [g for _, g in JOURNAL_ACCOUNTS], "NULL"), debit_amount="ext",
             closing_balance="CASE k % 14 WHEN 9 THEN ext WHEN 10 THEN 0 END", **jv),
        _leg(journal, pos="2", account_name="'HDFC Bank A/c'", account_group="'Bank Accounts'",
             credit_amount="ext", **jv),
    ]


cte("so", """SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(20,4)) AS price,
  CAST(o_orderdate AS DATE) AS day, o_orderstatus, o_orderpriority, c_name, c_nationkey, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey""")
cte("li", """SELECT l_orderkey AS k, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
  CAST(l_extendedprice AS DECIMAL(20,4)) AS ext, CAST(l_shipdate AS DATE) AS day,
  s_name, s_nationkey, p_brand, p_type
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""")
cte("gl_all", "SELECT *, CAST(debit_amount - credit_amount AS DECIMAL(20,4)) AS net_amount FROM (\n"
    + "\nUNION ALL ".join(_sales() + _purchases()) + ") legs", uses=("so", "li"))
cte("gl", "SELECT * FROM gl_all WHERE NOT excluded", uses=("gl_all",))
