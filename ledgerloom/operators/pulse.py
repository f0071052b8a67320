"""The daily pulse: balances, TDS hints and compliance deadlines per ledger."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import CR, DR, low, total_if

L = "ledger_id"

# fixed values: account-name patterns
CASH_BANK = r"\bcash\b|\bbank\b|\bcurrent account\b|\bsavings account\b|\bsb a/c\b|\bca a/c\b"
RECEIVABLE = r"\bsundry debtors?\b|\btrade receivables?\b|\baccounts? receivables?\b|\bdebtors?\b"
PAYABLE = r"\bsundry creditors?\b|\btrade payables?\b|\baccounts? payables?\b|\bcreditors?\b"
PAYMENT_TYPES = ["payment", "bank payment", "cash payment"]
TDS_LIMIT, TDS_RATE = 30000, "0.02"


def pulse_snapshot(gl: DataFrame) -> DataFrame:
    """Cash and bank, receivables, payables (absolute); NULL where the ledger has no such account."""
    name = low("account_name")

    def side(pattern: str) -> list[Column]:
        hit = name.rlike(pattern)
        return [total_if(hit, F.col("net")), F.max(hit)]

    # names are matched once per account, not once per posting
    accounts = gl.groupBy(L, "account_name").agg(F.sum(DR() - CR()).alias("net"))
    agg = accounts.groupBy(L).agg(*[c.alias(f"{n}{i}") for n, p in (("c", CASH_BANK), ("r", RECEIVABLE), ("p", PAYABLE))
                              for i, c in enumerate(side(p))])
    out = lambda n, v: F.when(F.col(f"{n}1"), F.round(v, 2).cast("double"))
    return agg.select(L, out("c", F.col("c0")).alias("cash_and_bank"), out("r", F.col("r0")).alias("receivables"),
                      out("p", F.abs("p0")).alias("payables"))


def pulse_tds_vendors(gl: DataFrame) -> DataFrame:
    """Payees with payments of at least 30,000 and no TDS leg, with the estimated TDS."""
    payee = F.coalesce("vendor_name", "party_name", "account_name", F.lit("Unknown"))
    amount = F.abs(F.coalesce("net_amount", "debit_amount", "credit_amount", F.lit(0)))
    agg = gl.filter(F.lower("voucher_type").isin(PAYMENT_TYPES)).groupBy(L, payee.alias("vendor")).agg(
        F.sum(amount).alias("paid"), F.bool_or(low("account_name").contains("tds")).alias("has_tds"))
    return agg.filter(~F.col("has_tds") & (F.col("paid") >= TDS_LIMIT)).select(
        L, "vendor", F.round("paid", 2).cast("double").alias("paid"),
        (F.col("paid") * F.lit(TDS_RATE).cast("decimal(4,2)")).alias("_due"))


def pulse_tds(gl: DataFrame) -> DataFrame:
    return pulse_tds_vendors(gl).groupBy(L).agg(
        F.count(F.lit(1)).alias("vendors"), F.round(F.sum("_due"), 2).cast("double").alias("tds_estimate")
    ).withColumn("category", F.lit("tds_calculator")).withColumn("severity", F.lit("review"))


def calendar(as_of: str) -> list[tuple[str, date, int, int, list[str], int | None]]:
    """(category, due, lead days, grace days, needed document types, critical when days left <= this)."""
    today = date.fromisoformat(as_of)
    y, m = today.year, today.month
    out: list[tuple[str, date, int, int, list[str], int | None]] = [
        ("tds_deadline", date(y, m, 7), 6, 2, [], -1),
        ("gstr1_deadline", date(y, m, 10), 2, 1, ["GL", "GSTR_1"], 0),
        ("gstr3b_deadline", date(y, m, 20), 2, 1, ["GL", "GSTR_3B"], 0),
    ]
    # fixed values: advance-tax instalments 15 Jun, 15 Sep, 15 Dec, 15 Mar; the first one in its window counts
    instalments = [date(y, 6, 15), date(y, 9, 15), date(y, 12, 15), date(y + 1 if m >= 4 else y, 3, 15)]
    live = [d for d in instalments if -2 <= (d - today).days <= 7]
    if live:
        out.append(("advance_tax", live[0], 7, 2, [], None))
    out.append(("itr_deadline", date(y, 7, 31), 14, 3, ["ITR"], 0))
    return [e for e in out if -e[3] <= (e[1] - today).days <= e[2]]


def pulse_deadlines(contexts: DataFrame, as_of: str) -> DataFrame:
    """Deadlines in their alert window.

    ``contexts``: (ledger_id, document_types array, data_intent, gl_max_date, snoozed array).
    """
    today = date.fromisoformat(as_of)
    live = calendar(as_of)
    stale = F.datediff(F.lit(as_of).cast("date"), "gl_max_date") > 90
    open_ = contexts.filter((F.col("data_intent") != "HISTORICAL") & ~F.coalesce(stale, F.lit(False)))
    if not live:
        return open_.limit(0).select(L, F.lit("").alias("category"), F.lit("").alias("severity"),
                                     F.lit(as_of).cast("date").alias("due_date"), F.lit(0).alias("days_left"))
    rows = F.array(*[F.struct(
        F.lit(c).alias("category"), F.lit(due.isoformat()).cast("date").alias("due_date"),
        F.lit((due - today).days).alias("days_left"),
        F.lit("critical" if crit is not None and (due - today).days <= crit else "review").alias("severity"),
        F.array(*[F.lit(n) for n in need]).cast("array<string>").alias("need")) for c, due, _, _, need, crit in live])
    each = open_.withColumn("e", F.explode(rows))
    wanted = (F.size("e.need") == 0) | F.arrays_overlap("e.need", "document_types")
    return each.filter(wanted & ~F.array_contains("snoozed", F.col("e.category"))).select(
        L, "e.category", "e.severity", "e.due_date", "e.days_left")


def pulse_digest(gl: DataFrame, contexts: DataFrame, as_of: str, done: DataFrame | None = None,
                 cadence: DataFrame | None = None) -> DataFrame:
    """One digest per ledger and day.

    ``done`` (ledger_id, day) are digests already written for the day and are
    left out; ``cadence`` (ledger_id, cadence) holds WEEKLY ledgers back until Monday.
    """
    alerts = pulse_deadlines(contexts, as_of).select(L, "category", "severity").unionByName(
        pulse_tds(gl).select(L, "category", "severity"))
    # at most one alert per category, so the lists are as short as the calendar
    per = alerts.groupBy(L).agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    out = contexts.select(L).join(pulse_snapshot(gl), L, "left").join(per, L, "left")
    out = out.withColumn("day", F.lit(as_of).cast("date")).fillna(0, ["alerts", "critical"]).fillna("", ["categories"])
    if cadence is not None and date.fromisoformat(as_of).weekday() != 0:
        out = out.join(cadence.filter("cadence = 'WEEKLY'").select(L), L, "left_anti")
    if done is not None:
        out = out.join(done.select(L, "day"), [L, "day"], "left_anti")
    return out.select(L, "day", "alerts", "critical", "categories", "cash_and_bank", "receivables", "payables")
