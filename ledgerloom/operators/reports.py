"""The fifty canned ledger reports, one row set per ledger.

``report(name, gl, as_of)`` dispatches.  Every report groups by ``ledger_id``
first, sums in decimal, and rounds to two places in a double at the end.  A
row limit appears only where the report is a top-k list, and applies per
ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import (
    CR, DR, best_credit, best_debit, first_nonzero, keyword_any, money, month, num,
    party_columns, top_per, total_if, with_parties,
)

L = "ledger_id"
Ordered = tuple[DataFrame, list[Column]]
REPORTS: dict[str, Callable[[DataFrame, str], Ordered]] = {}


def _report(fn: Callable[[DataFrame, str], Ordered]) -> Callable[[DataFrame, str], Ordered]:
    REPORTS[fn.__name__] = fn
    return fn


def report(name: str, gl: DataFrame, as_of: str, ordered: bool = True, parties: DataFrame | None = None) -> DataFrame:
    """Run a report; ``ordered=False`` leaves out the final sort (for joins, unions, sinks).

    ``parties`` is ``party_columns(gl)`` kept as a table: a stored table of one
    row per ledger has a known size, so Spark joins it without moving the ledger.
    """
    if name not in REPORTS:
        raise KeyError(f"no report named {name}; have {sorted(REPORTS)}")
    if name in PARTY_REPORTS:
        gl = with_parties(gl, party_columns(gl) if parties is None else parties)
    rows, order = REPORTS[name](gl, as_of)
    return rows.orderBy(*order) if ordered else rows


# reports that name vendors or customers by the column their ledger uses
PARTY_REPORTS = {
    "overdue_debtors_30_60_90", "vendor_ledger", "customer_ledger", "creditors_top_10", "debtors_top_10",
    "top_customers", "sales_last_quarter", "vendor_payment_summary", "customer_receipts_summary",
    "purchase_register", "sales_register", "pending_bills",
}

# --- shared shapes -----------------------------------------------------------

BALANCE_GROUPS = ["asset", "liabilit", "equity", "capital", "loan", "reserve"]
BANK_WORDS = ["bank", "savings", "current account", "hdfc", "icici", "sbi", "axis"]
ASSET_GROUPS = ["fixed asset", "capital work", "plant", "equipment", "machinery",
                "furniture", "vehicle", "building", "land"]


def _sorted(df: DataFrame, *order: Column) -> Ordered:
    return df, [F.col(L), *order]


def _desc(c: str) -> Column:
    return F.col(c).desc_nulls_last()


def _has_date(gl: DataFrame) -> DataFrame:
    return gl.filter(F.col("transaction_date").isNotNull())


def _listing(rows: DataFrame, *columns: Column) -> Ordered:
    """All rows, newest first; ``row_id`` breaks ties."""
    newest = [F.col("transaction_date").desc_nulls_first(), F.col("row_id")]
    return _sorted(rows.select(L, "row_id", "transaction_date", *columns), *newest)


def _sides() -> list[Column]:
    return [money(DR()).alias("debit"), money(CR()).alias("credit")]


def _balances(gl: DataFrame, key: Column, key_name: str, value: Column, value_name: str,
              keep: Column | None = None) -> Ordered:
    out = gl.groupBy(L, key.alias(key_name)).agg(value.alias("_v"))
    out = out.filter(F.col("_v") > 0) if keep is None else out.filter(keep)
    return _sorted(out.select(L, key_name, money(F.col("_v")).alias(value_name)), _desc(value_name), F.col(key_name))


def previous_quarter(as_of: str) -> tuple[Column, Column]:
    this = F.trunc(F.lit(as_of).cast("date"), "quarter")
    return F.add_months(this, -3), this


# --- balances by account or party --------------------------------------------


@_report
def ap_aging(gl, as_of):
    return _balances(gl, F.col("account_name"), "account_name", F.sum("debit_amount") - F.sum(CR()), "outstanding")


@_report
def ar_aging(gl, as_of):
    return _balances(gl, F.col("account_name"), "account_name", F.sum("credit_amount") - F.sum(DR()), "outstanding")


@_report
def top_vendors(gl, as_of):
    agg = gl.groupBy(L, "account_name").agg(money(F.sum("debit_amount")).alias("total_spend"))
    return _sorted(top_per(agg, [L], [_desc("total_spend"), F.col("account_name")], 10),
                   _desc("total_spend"), F.col("account_name"))


@_report
def monthly_summary(gl, as_of):
    return _sorted(
        gl.groupBy(L, F.trunc("transaction_date", "month").alias("month")).agg(
            money(F.sum("debit_amount")).alias("total_debits"), money(F.sum(CR())).alias("total_credits")),
        F.col("month"))


def _by_cost_centre(gl: DataFrame, value: Column, name: str, counted: bool) -> Ordered:
    aggs = ([F.count(F.lit(1)).alias("transactions")] if counted else []) + [money(F.sum(value)).alias(name)]
    return _sorted(gl.filter(F.col("cost_centre").isNotNull()).groupBy(L, "cost_centre").agg(*aggs),
                   _desc(name), F.col("cost_centre"))


@_report
def cost_centre_breakdown(gl, as_of):
    return _by_cost_centre(gl, F.col("debit_amount"), "total", counted=False)


@_report
def cost_centre_revenue(gl, as_of):
    return _by_cost_centre(gl, best_credit(), "revenue", counted=True)


@_report
def cost_centre_expenses(gl, as_of):
    return _by_cost_centre(gl, best_debit(), "expenses", counted=True)


@_report
def cash_balance(gl, as_of):
    """The ledger snapshot where the account has one, else credits less debits."""
    agg = (
        gl.filter(keyword_any(["account_name"], ["cash", "bank", "savings"])
                  & (keyword_any(["account_name"], ["cash", "bank"]) | F.col("closing_balance").isNotNull()))
        .groupBy(L, "account_name")
        .agg(F.max("closing_balance").alias("snapshot"), F.sum(CR() - DR()).alias("moved")))
    kept = agg.filter(F.col("snapshot").isNotNull() | (F.round("moved", 2) > 0))
    return _sorted(kept.select(L, "account_name", money(F.coalesce("snapshot", "moved")).alias("balance")),
                   _desc("balance"), F.col("account_name"))


@_report
def overdue_debtors_30_60_90(gl, as_of):
    age = F.datediff(F.lit(as_of).cast("date"), F.col("transaction_date"))
    net = best_debit() - CR()
    agg = _has_date(gl).groupBy(
        L, F.coalesce("customer_party", F.lit("Unknown")).alias("customer")
    ).agg(
        total_if(age.between(0, 30), net).alias("a"), total_if(age.between(31, 60), net).alias("b"),
        total_if(age.between(61, 90), net).alias("c"), total_if(age > 90, net).alias("d"),
        F.sum(net).alias("t"))
    return _sorted(
        agg.filter(F.round("t", 2) > 0).select(
            L, "customer", money(F.col("a")).alias("0_30_days"), money(F.col("b")).alias("31_60_days"),
            money(F.col("c")).alias("61_90_days"), money(F.col("d")).alias("over_90_days"),
            money(F.col("t")).alias("total_outstanding")),
        _desc("total_outstanding"), F.col("customer"))


@_report
def vendor_ledger(gl, as_of):
    agg = gl.filter(F.col("vendor_party").isNotNull()).groupBy(L, F.col("vendor_party").alias("vendor")).agg(
        F.count(F.lit(1)).alias("transactions"), money(F.sum(best_debit())).alias("total_purchases"),
        money(F.sum(CR())).alias("total_paid"), money(F.sum(best_debit()) - F.sum(CR())).alias("outstanding"))
    return _sorted(agg, _desc("outstanding"), F.col("vendor"))


@_report
def customer_ledger(gl, as_of):
    agg = gl.filter(F.col("customer_party").isNotNull()).groupBy(L, F.col("customer_party").alias("customer")).agg(
        F.count(F.lit(1)).alias("transactions"), money(F.sum(best_credit())).alias("total_sales"),
        money(F.sum(DR())).alias("total_received"), money(F.sum(best_credit()) - F.sum(DR())).alias("outstanding"))
    return _sorted(agg, _desc("outstanding"), F.col("customer"))


def _top_party(gl: DataFrame, party: Column, name: str, value: Column) -> Ordered:
    agg = gl.filter(party.isNotNull()).groupBy(L, party.alias(name)).agg(money(value).alias("outstanding"))
    order = [_desc("outstanding"), F.col(name)]
    return _sorted(top_per(agg.filter(F.col("outstanding") > 0), [L], order, 10), *order)


@_report
def creditors_top_10(gl, as_of):
    return _top_party(gl, F.col("vendor_party"), "creditor", F.sum(best_debit()) - F.sum(CR()))


@_report
def debtors_top_10(gl, as_of):
    return _top_party(gl, F.col("customer_party"), "debtor", F.sum(best_credit()) - F.sum(DR()))


@_report
def top_customers(gl, as_of):
    agg = gl.filter(F.col("customer_party").isNotNull()).groupBy(L, F.col("customer_party").alias("customer")).agg(
        F.count(F.lit(1)).alias("transactions"), money(F.sum(best_credit())).alias("total_revenue"))
    order = [_desc("total_revenue"), F.col("customer")]
    return _sorted(top_per(agg, [L], order, 10), *order)


@_report
def advance_payments_outstanding(gl, as_of):
    party = F.coalesce("vendor_name", "customer_name", "party_name", "account_name", F.lit("Unknown"))
    agg = (gl.filter(keyword_any(["account_name", "description", "voucher_type"], ["advance"]))
           .groupBy(L, party.alias("party"))
           .agg(F.count(F.lit(1)).alias("count"), money(F.sum(best_debit())).alias("total_advance"))
           .filter(F.col("total_advance") > 0))
    return _sorted(agg, _desc("total_advance"), F.col("party"))


@_report
def zero_balance_accounts(gl, as_of):
    agg = gl.filter(F.col("account_name").isNotNull()).groupBy(
        L, "account_name", F.coalesce("account_group", F.lit("Unknown")).alias("category")
    ).agg(F.max("closing_balance").alias("snapshot"), F.sum(DR() - CR()).alias("moved"))
    out = agg.select(L, "account_name", "category", money(F.coalesce("snapshot", "moved")).alias("balance"))
    return _sorted(out.filter(F.abs("balance") < 0.01), F.col("account_name"), F.col("category"))


# --- monthly -----------------------------------------------------------------


@_report
def gst_summary(gl, as_of):
    amount = F.coalesce("net_amount", "debit_amount", F.lit(0))
    where = ["account_name", "description"]
    agg = _has_date(gl).filter(keyword_any(where, ["gst"])).groupBy(L, month().alias("month")).agg(
        *[money(total_if(keyword_any(where, [w]), amount)).alias(w) for w in ("cgst", "sgst", "igst")],
        money(total_if(keyword_any(where, ["gst"]), amount)).alias("total_gst"))
    return _sorted(agg, F.col("month"))


@_report
def gst_input_vs_output(gl, as_of):
    acct_in, acct_out = keyword_any(["account_name"], ["input"]), keyword_any(["account_name"], ["output"])
    text_in, text_out = keyword_any(["description"], ["input%gst"]), keyword_any(["description"], ["output%gst"])
    dr, cr = best_debit(), best_credit()
    agg = _has_date(gl).filter(keyword_any(["account_name", "description"], ["gst"])).groupBy(
        L, month().alias("month")).agg(
        money(total_if(acct_in | text_in, dr)).alias("input_gst"),
        money(total_if(acct_out | text_out, cr)).alias("output_gst"),
        money(total_if(acct_out, cr) - total_if(acct_in, dr)).alias("net_gst_payable"))
    return _sorted(agg, F.col("month"))


@_report
def payroll_summary(gl, as_of):
    hit = (keyword_any(["account_name"], ["salary", "payroll", "wages", "remuneration", "staff"])
           | keyword_any(["voucher_type"], ["payroll"])
           | keyword_any(["description"], ["salary", "payroll", "wages"]))
    who = F.coalesce("party_name", "account_name", F.lit("Unknown"))
    agg = gl.filter(hit).groupBy(L, month().alias("month")).agg(
        F.count_distinct(who).alias("employees"), money(F.sum(best_debit())).alias("total_salary"))
    return _sorted(agg, F.col("month"))


@_report
def tds_summary(gl, as_of):
    party = F.coalesce("party_name", "vendor_name", "account_name", F.lit("Unknown"))
    amount = first_nonzero("debit_amount", "credit_amount", "net_amount")
    agg = (gl.filter(keyword_any(["account_name", "description", "account_group"], ["tds"]))
           .groupBy(L, month().alias("month"), party.alias("deductee"))
           .agg(money(F.sum(amount)).alias("tds_amount")))
    return _sorted(agg, F.col("month"), _desc("tds_amount"), F.col("deductee"))


@_report
def cash_flow_monthly(gl, as_of):
    agg = _has_date(gl).filter(keyword_any(["account_name"], ["cash", "bank"])).groupBy(
        L, month().alias("month")).agg(
        money(F.sum(CR())).alias("inflows"), money(F.sum(DR())).alias("outflows"),
        money(F.sum(CR()) - F.sum(DR())).alias("net_cash_flow"))
    return _sorted(agg, F.col("month"))


@_report
def sales_last_quarter(gl, as_of):
    lo, hi = previous_quarter(as_of)
    hit = keyword_any(["voucher_type"], ["sales", "invoice"]) | F.col("customer_party").isNotNull()
    d = F.col("transaction_date")
    agg = gl.filter((d >= lo) & (d < hi) & hit).groupBy(
        L, month().alias("month"), F.coalesce(F.col("customer_party"), F.lit("Unknown")).alias("customer")
    ).agg(money(F.sum(best_credit())).alias("sales"))
    return _sorted(agg, F.col("month"), _desc("sales"), F.col("customer"))


@_report
def expenses_last_quarter(gl, as_of):
    lo, hi = previous_quarter(as_of)
    d = F.col("transaction_date")
    agg = gl.filter((d >= lo) & (d < hi)).groupBy(
        L, month().alias("month"), _category().alias("category")
    ).agg(money(F.sum(best_debit())).alias("expenses"))
    return _sorted(agg, F.col("month"), _desc("expenses"), F.col("category"))


@_report
def yoy_comparison_monthly(gl, as_of):
    this = int(as_of[:4])
    cr, y = best_credit(), F.year("transaction_date")
    # plain date bounds, so the two-year slice can prune files
    window = F.col("transaction_date").between(
        F.lit(f"{this - 1}-01-01").cast("date"), F.lit(f"{this}-12-31").cast("date"))
    agg = gl.filter(window).groupBy(L, F.date_format("transaction_date", "MM").alias("month")).agg(
        money(total_if(y == this, cr)).alias("current_year"),
        money(total_if(y == this - 1, cr)).alias("previous_year"),
        money(total_if(y == this, cr) - total_if(y == this - 1, cr)).alias("yoy_growth"))
    return _sorted(agg, F.col("month"))


def _category() -> Column:
    return F.coalesce("account_group", "account_type", F.lit("Unclassified"))


@_report
def budget_variance(gl, as_of):
    monthly = _has_date(gl).groupBy(L, month().alias("month"), _category().alias("category")).agg(
        F.round(F.sum(best_debit()), 2).alias("actual"))
    typical = F.avg("actual").over(Window.partitionBy(L, "category"))
    out = monthly.select(
        L, "month", "category", F.col("actual").cast("double").alias("actual"),
        money(typical).alias("avg_monthly"), money(F.col("actual") - typical).alias("variance_from_avg"))
    return _sorted(out, F.col("month"), F.abs("variance_from_avg").desc(), F.col("category"))


@_report
def forecast_vs_actual(gl, as_of):
    monthly = _has_date(gl).groupBy(L, month().alias("month")).agg(
        F.round(F.sum(best_credit()), 2).alias("actual"))
    prior = F.lag("actual", 1).over(Window.partitionBy(L).orderBy("month")) * F.lit("1.05").cast("decimal(4,2)")
    return _sorted(
        monthly.select(
            L, "month", F.col("actual").cast("double").alias("actual_revenue"),
            money(prior).alias("forecast_5pct_growth"),
            money(F.col("actual") - F.coalesce(prior, F.col("actual"))).alias("variance")),
        F.col("month"))


@_report
def depreciation_schedule(gl, as_of):
    agg = (gl.filter(keyword_any(["account_name", "account_group", "description"], ["depreciation"]))
           .groupBy(L, month().alias("month"), F.col("account_name").alias("asset"))
           .agg(money(F.sum(best_debit())).alias("depreciation_amount")))
    return _sorted(agg, F.col("month"), _desc("depreciation_amount"), F.col("asset"))


@_report
def vendor_payment_summary(gl, as_of):
    hit = keyword_any(["voucher_type"], ["payment"]) | F.col("vendor_party").isNotNull()
    agg = _has_date(gl).filter(hit).groupBy(
        L, F.coalesce(F.col("vendor_party"), F.lit("Unknown")).alias("vendor"), month().alias("month")
    ).agg(F.count(F.lit(1)).alias("payments"),
          money(F.sum(CR())).alias("total_paid"))
    return _sorted(agg, F.col("month"), _desc("total_paid"), F.col("vendor"))


@_report
def customer_receipts_summary(gl, as_of):
    hit = keyword_any(["voucher_type"], ["receipt"]) | F.col("customer_party").isNotNull()
    agg = _has_date(gl).filter(hit).groupBy(
        L, F.coalesce(F.col("customer_party"), F.lit("Unknown")).alias("customer"), month().alias("month")
    ).agg(F.count(F.lit(1)).alias("receipts"),
          money(F.sum(DR())).alias("total_received"))
    return _sorted(agg, F.col("month"), _desc("total_received"), F.col("customer"))


@_report
def account_monthly_drill(gl, as_of):
    agg = _has_date(gl).filter(F.col("account_name").isNotNull()).groupBy(
        L, "account_name", month().alias("month")).agg(
        money(F.sum(DR())).alias("debits"), money(F.sum(CR())).alias("credits"),
        money(F.sum(CR()) - F.sum(DR())).alias("net"))
    return _sorted(agg, F.col("account_name"), F.col("month"))


@_report
def period_close_summary(gl, as_of):
    agg = _has_date(gl).groupBy(L, month().alias("period"), _category().alias("category")).agg(
        F.count(F.lit(1)).alias("entries"), money(F.sum(DR())).alias("total_debits"),
        money(F.sum(CR())).alias("total_credits"), money(F.sum(CR()) - F.sum(DR())).alias("net"))
    return _sorted(agg, F.col("period"), F.abs("net").desc(), F.col("category"))


# --- registers and listings --------------------------------------------------


@_report
def purchase_register(gl, as_of):
    rows = gl.filter(keyword_any(["voucher_type"], ["purchase", "bill"]) | F.col("vendor_party").isNotNull())
    return _listing(
        rows, F.coalesce(F.col("vendor_party"), F.lit("Unknown")).alias("vendor"),
        F.coalesce("reference_number", "document_number").alias("bill_no"),
        F.col("description").alias("narration"), money(best_debit()).alias("amount"))


@_report
def sales_register(gl, as_of):
    rows = gl.filter(keyword_any(["voucher_type"], ["sales", "invoice"]) | F.col("customer_party").isNotNull())
    return _listing(
        rows, F.coalesce(F.col("customer_party"), F.lit("Unknown")).alias("customer"),
        F.coalesce("reference_number", "document_number").alias("invoice_no"),
        F.col("description").alias("narration"), money(best_credit()).alias("amount"))


def _voucher_columns() -> list[Column]:
    return [F.coalesce("reference_number", "document_number").alias("voucher_no"),
            F.col("account_name").alias("account"), F.col("description").alias("narration"), *_sides()]


@_report
def journal_entries(gl, as_of):
    hit = keyword_any(["voucher_type"], ["journal", "jv"]) | keyword_any(["description"], ["journal"])
    return _listing(gl.filter(hit), *_voucher_columns())


@_report
def contra_entries(gl, as_of):
    cash_to_bank = keyword_any(["account_name"], ["cash"]) & keyword_any(["description"], ["bank"])
    bank_to_cash = keyword_any(["account_name"], ["bank"]) & keyword_any(["description"], ["cash"])
    hit = keyword_any(["voucher_type"], ["contra"]) | cash_to_bank | bank_to_cash
    return _listing(gl.filter(hit), *_voucher_columns())


@_report
def provisions(gl, as_of):
    rows = gl.filter(keyword_any(["account_name", "description", "account_group"], ["provision"]))
    return _listing(rows, F.col("account_name").alias("account"),
                    F.col("account_group"), F.col("description").alias("narration"), *_sides())


@_report
def write_offs(gl, as_of):
    rows = gl.filter(keyword_any(["account_name", "description"], ["write%off", "bad debt", "written off"]))
    return _listing(rows, F.col("account_name").alias("account"),
                    F.col("description").alias("narration"), *_sides())


@_report
def intercompany_transactions(gl, as_of):
    hit = keyword_any(["account_name"], ["intercompany", "inter company", "related party", "group company",
                                         "subsidiary", "holding"]) | keyword_any(
        ["description"], ["intercompany", "related party", "group company"])
    return _listing(gl.filter(hit), F.col("account_name").alias("entity"),
                    F.col("description").alias("narration"), *_sides())


@_report
def large_transactions(gl, as_of):
    # a missing side is stored as 0 here, so the larger side is the amount
    amount = F.greatest(DR(), CR(), F.abs(num("net_amount")))
    return _listing(gl.filter(amount >= 100000), F.col("account_name").alias("account"),
                    F.col("reference_number").alias("reference"),
                    F.col("description").alias("narration"), money(amount).alias("amount"))


@_report
def pending_bills(gl, as_of):
    today = F.lit(as_of).cast("date")
    rows = gl.filter(keyword_any(["voucher_type"], ["purchase", "invoice", "bill"])
                     & F.col("due_date").isNotNull() & (F.col("due_date") < today))
    out = rows.select(
        L, "row_id", F.coalesce(F.col("vendor_party"), F.lit("Unknown")).alias("vendor"),
        F.coalesce("reference_number", "document_number").alias("bill_no"),
        "transaction_date", "due_date", F.datediff(today, "due_date").alias("days_overdue"),
        money(best_debit()).alias("amount"))
    return _sorted(out, _desc("days_overdue"), F.col("row_id"))


# --- groupings ---------------------------------------------------------------


@_report
def profit_loss_summary(gl, as_of):
    category = F.coalesce("account_group", "account_type")
    agg = gl.filter(category.isNotNull()).groupBy(L, category.alias("category")).agg(
        money(F.sum(CR())).alias("total_income"), money(F.sum(DR())).alias("total_expense"),
        money(F.sum(CR()) - F.sum(DR())).alias("net"))
    return _sorted(agg, _desc("net"), F.col("category"))


@_report
def balance_sheet_snapshot(gl, as_of):
    category = F.coalesce("account_group", "account_type")
    agg = gl.filter(category.isNotNull() & keyword_any([category], BALANCE_GROUPS)).groupBy(
        L, category.alias("category")).agg(
        F.sum("closing_balance").alias("snapshot"), F.sum(DR() - CR()).alias("moved"))
    return _sorted(agg.select(L, "category", money(F.coalesce("snapshot", "moved")).alias("balance")),
                   _desc("balance"), F.col("category"))


@_report
def expense_by_voucher_type(gl, as_of):
    kind = F.coalesce("voucher_type", "transaction_type", "account_group")
    agg = gl.filter(kind.isNotNull()).groupBy(L, kind.alias("type")).agg(
        F.count(F.lit(1)).alias("transactions"), money(F.sum(best_debit())).alias("total_amount"))
    return _sorted(agg, _desc("total_amount"), F.col("type"))


@_report
def bank_reconciliation(gl, as_of):
    agg = gl.filter(keyword_any(["account_name"], BANK_WORDS)).groupBy(
        L, F.coalesce("account_name", F.lit("Bank")).alias("bank_account")).agg(
        F.count(F.lit(1)).alias("entries"), money(F.sum(CR())).alias("total_credits"),
        money(F.sum(DR())).alias("total_debits"), money(F.sum(CR()) - F.sum(DR())).alias("net_balance"))
    return _sorted(agg, _desc("net_balance"), F.col("bank_account"))


@_report
def multi_currency_summary(gl, as_of):
    agg = gl.groupBy(L, F.coalesce("currency_code", F.lit("INR")).alias("currency")).agg(
        F.count(F.lit(1)).alias("transactions"), money(F.sum(DR())).alias("total_debits"),
        money(F.sum(CR())).alias("total_credits"))
    return _sorted(agg, (F.col("total_debits") + F.col("total_credits")).desc(), F.col("currency"))


@_report
def unrealized_gains_losses(gl, as_of):
    currency = F.coalesce("currency_code", F.lit("INR"))
    hit = (keyword_any(["account_name"], ["forex", "exchange", "fx ", "foreign"])
           | keyword_any(["description"], ["unrealized", "exchange gain", "exchange loss", "forex"])
           | (currency != "INR"))
    agg = gl.filter(hit).groupBy(L, currency.alias("currency"), F.col("account_name").alias("account")).agg(
        money(F.sum(DR())).alias("total_debit"), money(F.sum(CR())).alias("total_credit"),
        money(F.sum(CR()) - F.sum(DR())).alias("net_position"))
    return _sorted(agg, F.abs("net_position").desc(), F.col("currency"), F.col("account"))


def _current_sides(gl: DataFrame) -> DataFrame:
    """Current assets and liabilities per ledger; a closing balance beats movements."""
    group = F.coalesce("account_group", "account_type")
    net = F.coalesce(F.col("closing_balance"), DR() - CR())
    return gl.groupBy(L).agg(
        total_if(keyword_any([group], ["current asset"]), net).alias("a"),
        total_if(keyword_any([group], ["current liabilit"]), F.abs(net)).alias("b"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.round(top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0)), 2)


@_report
def current_ratio(gl, as_of):
    a, b = F.col("a"), F.col("b")
    return _sorted(_current_sides(gl).select(
        L, money(a).alias("current_assets"), money(b).alias("current_liabilities"),
        _ratio(a, b).alias("current_ratio")))


@_report
def working_capital(gl, as_of):
    a, b = F.col("a"), F.col("b")
    return _sorted(_current_sides(gl).select(
        L, money(a).alias("current_assets"), money(b).alias("current_liabilities"),
        money(a - b).alias("working_capital")))


@_report
def debt_equity_ratio(gl, as_of):
    group = F.coalesce("account_group", "account_type")
    size = F.abs(F.coalesce(F.col("closing_balance"), best_debit()))
    debt, equity = ["loan", "borrowing", "debt"], ["equity", "capital", "reserve"]
    agg = gl.groupBy(L).agg(
        total_if(keyword_any([group], debt + ["term loan"]), size).alias("d"),
        total_if(keyword_any([group], equity + ["surplus"]), size).alias("e"),
        total_if(keyword_any([group], debt), size).alias("d0"),
        total_if(keyword_any([group], equity), size).alias("e0"))
    return _sorted(agg.select(
        L, money(F.col("d")).alias("total_debt"), money(F.col("e")).alias("total_equity"),
        _ratio(F.col("d0"), F.col("e0")).alias("debt_equity_ratio")))


@_report
def fixed_asset_summary(gl, as_of):
    group = F.coalesce("account_group", "account_type")
    agg = gl.filter(keyword_any([F.coalesce(group, F.col("account_name"))], ASSET_GROUPS)).groupBy(
        L, F.col("account_name").alias("asset"), F.coalesce(group, F.lit("Fixed Asset")).alias("category")).agg(
        money(F.sum(DR())).alias("gross_value"), money(F.sum(CR())).alias("accumulated_depreciation"),
        money(F.sum(DR()) - F.sum(CR())).alias("net_book_value"))
    return _sorted(agg, _desc("gross_value"), F.col("asset"))


# --- dashboard ---------------------------------------------------------------

# fixed values: the six pinned cards in order -> (report, title, label column, value column)
PINNED = [
    ("cash_balance", "Cash & Bank Balance", "account_name", "balance"),
    ("debtors_top_10", "Outstanding Receivables (Top 10)", "debtor", "outstanding"),
    ("creditors_top_10", "Outstanding Payables (Top 10)", "creditor", "outstanding"),
    ("cash_flow_monthly", "Monthly Cash Flow", "month", "net_cash_flow"),
    ("expense_by_voucher_type", "Expenses by Type", "type", "total_amount"),
    ("cost_centre_breakdown", "Cost Centre Summary", "cost_centre", "total"),
]


def dashboard_cards(gl: DataFrame, as_of: str, parties: DataFrame | None = None) -> DataFrame:
    """The pinned cards of every ledger in one long table."""
    out = None
    for position, (name, title, label, value) in enumerate(PINNED):
        card = report(name, gl, as_of, ordered=False, parties=parties).select(
            L, F.lit(position).alias("position"), F.lit(title).alias("title"),
            F.col(label).alias("label"), F.col(value).alias("value"))
        out = card if out is None else out.unionByName(card)
    return out
