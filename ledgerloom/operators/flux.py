"""Period-over-period variance and P&L review."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import CR, DR, in_period, low, total_if, top_per
from .accounts import with_account_type
from .rollups import Rollups

L = "ledger_id"

# fixed values: materiality
MATERIAL_ABS, MATERIAL_PCT = 50000, 10
QUESTION_MIN_IMPACT, QUESTION_MAX, TRIGGERS_TOP = 10000, 3, 5
KNOWN_CONFIDENCE = 0.6
STANDARD_ACCOUNTS = ["depreciation", "salary", "rent"]
MARGIN_POINTS = 15
PL_TYPES = ["REVENUE", "COGS", "EXPENSE", "OTHER_INCOME"]


def prior_period(start: str, end: str) -> tuple[str, str]:
    """Same length, ending the day before ``start``."""
    s, e = date.fromisoformat(start), date.fromisoformat(end)
    last = s - timedelta(days=1)
    return (last - (e - s)).isoformat(), last.isoformat()


def prior_period_columns(start: Column, end: Column) -> tuple[Column, Column]:
    """The same for a table of periods."""
    last = F.date_sub(start, 1)
    return F.date_sub(last, F.datediff(end, start)), last


def account_periods(gl: DataFrame | Rollups, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """Per account: current and prior net (debit less credit) in one pass; absent sides are 0."""
    p0, p1 = prior_period(start, end)
    now, before = in_period(start, end), in_period(p0, p1)
    if isinstance(gl, Rollups):
        return with_account_type(gl.by_period(now, before, in_period(p0, end)), overrides)
    both = gl.filter(in_period(p0, end) & (F.coalesce("account_name", F.lit("")) != ""))
    return with_account_type(both.groupBy(L, "account_name").agg(
        F.max("account_group").alias("account_group"),
        total_if(now, DR() - CR()).alias("current"), total_if(before, DR() - CR()).alias("prior"),
        F.count_if(now).alias("n_now"), F.count_if(before).alias("n_before")), overrides)


def _material(variance: Column, prior: Column) -> Column:
    return (F.abs(variance) >= MATERIAL_ABS) & (
        (prior == 0) | (F.abs(variance) * 100 >= F.abs(prior) * MATERIAL_PCT))


def flux(gl: DataFrame | Rollups, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """Account variances; rows under 1 on both sides are left out."""
    a = account_periods(gl, start, end, overrides)
    cur, pri = F.col("current"), F.col("prior")
    var = cur - pri
    pct = F.when(pri != 0, F.round(var.cast("double") / F.abs(pri).cast("double") * 100, 4))
    return a.filter((F.abs(cur) >= 1) | (F.abs(pri) >= 1)).select(
        L, "account_name", "account_type", F.round(cur, 2).cast("double").alias("current_balance"),
        F.round(pri, 2).cast("double").alias("prior_balance"), F.round(var, 2).cast("double").alias("variance"),
        pct.alias("variance_pct"), (pri == 0).alias("is_new_activity"), _material(var, pri).alias("is_material"))


def sort_material_first(changes: DataFrame) -> DataFrame:
    return changes.orderBy(L, F.col("is_material").desc(), F.abs("variance").desc(), "account_name")


def flux_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy(L).agg(
        F.count(F.lit(1)).alias("total_accounts"), F.count_if("is_material").alias("material_count"),
        total_if(F.col("is_material"), F.abs("variance").cast("decimal(38,2)")).cast("double")
        .alias("total_abs_variance"))


def _pl_sums(a: DataFrame, column: str, prefix: str = "") -> list[Column]:
    sign = {"REVENUE": -1, "COGS": 1, "EXPENSE": 1, "OTHER_INCOME": -1}
    return [total_if(F.col("account_type") == t, F.col(column) * sign[t]).alias(prefix + t.lower()) for t in PL_TYPES]


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double") * 100, 4)).otherwise(F.lit(0.0))


def pl_numbers(gl: DataFrame, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """Headline profit and loss per ledger."""
    n = account_periods(gl, start, end, overrides).groupBy(L).agg(*_pl_sums(None, "current"))
    rev, gross = F.col("revenue"), F.col("revenue") - F.col("cogs")
    operating = gross - F.col("expense")
    money = lambda c, name: F.round(c, 2).cast("double").alias(name)
    return n.select(
        L, money(rev, "revenue"), money(F.col("cogs"), "cogs"), money(gross, "gross_profit"),
        _pct(gross, rev).alias("gross_margin_pct"), money(F.col("expense"), "operating_expenses"),
        money(operating, "operating_profit"), money(F.col("other_income"), "other_income"),
        _pct(operating + F.col("other_income"), rev).alias("net_profit_pct"))


TRIGGER = [L, "reason", "account", "priority", "impact", "pattern_key"]


def pl_triggers(gl: DataFrame, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """What a reviewer should look into, by rule."""
    a = account_periods(gl, start, end, overrides)
    is_pl, live = F.col("account_type").isin(PL_TYPES), F.col("n_now") > 0
    cur, pri = F.abs("current"), F.abs("prior")
    change = cur - pri
    new = (pri == 0) & (cur > 50000)
    moved = (pri > 0) & (F.abs(change) * 100 > pri * 25) & (F.abs(change) > 50000)
    accounts = a.filter(is_pl & live & (new | moved)).select(
        L, F.when(new, "new_activity").otherwise("material_variance").alias("reason"),
        F.col("account_name").alias("account"),
        F.when(new, 8).when(change > pri, 10).otherwise(7).alias("priority"),
        F.round(cur, 2).cast("double").alias("impact"))
    words = []
    for w in STANDARD_ACCOUNTS:
        named = low("account_name").contains(w)
        words += [F.max(is_pl & live & named).alias(f"{w}_now"),
                  F.max((F.col("n_before") > 0) & named).alias(f"{w}_before")]
    per = a.groupBy(L).agg(*words, *_pl_sums(a, "current", "c_"), *_pl_sums(a, "prior", "p_"))
    now_margin = _pct(F.col("c_revenue") - F.col("c_cogs"), F.col("c_revenue"))
    old_margin = _pct(F.col("p_revenue") - F.col("p_cogs"), F.col("p_revenue"))
    general = [F.when(F.col(f"{w}_before") & ~F.col(f"{w}_now"),
                      F.struct(F.lit(f"missing_{w}").alias("reason"), F.lit(9).alias("priority")))
               for w in STANDARD_ACCOUNTS]
    general.append(F.when(
        (F.col("p_revenue") > 0) & (F.col("c_revenue") > 0) & (F.abs(now_margin - old_margin) > MARGIN_POINTS),
        F.struct(F.lit("margin_shift").alias("reason"), F.lit(8).alias("priority"))))
    rest = per.select(L, F.explode(F.array_compact(F.array(*general))).alias("g")).select(
        L, "g.reason", F.lit(None).cast("string").alias("account"), "g.priority", F.lit(50000.0).alias("impact"))
    return accounts.unionByName(rest).withColumn(
        "pattern_key", F.concat_ws(":", "reason", F.coalesce("account", F.lit("general")))).select(*TRIGGER)


def pl_questions(triggers: DataFrame, knowledge: DataFrame) -> DataFrame:
    """The five first triggers nobody has answered yet; the first three of size become questions.

    ``knowledge`` has (ledger_id, pattern_key, confidence).
    """
    known = knowledge.filter(F.col("confidence") >= KNOWN_CONFIDENCE).select(L, "pattern_key")
    order = [F.col("priority").desc(), F.col("impact").desc(), F.col("pattern_key")]
    top = top_per(triggers.join(known, [L, "pattern_key"], "left_anti"), [L], order, TRIGGERS_TOP)
    big = F.col("impact") >= QUESTION_MIN_IMPACT
    nth = F.sum(big.cast("int")).over(Window.partitionBy(L).orderBy(*order))
    return top.withColumn("asked", big & (nth <= QUESTION_MAX)).select(
        *TRIGGER, "asked", F.when(F.col("priority") >= 9, "critical").when(F.col("priority") >= 7, "review")
        .otherwise("info").alias("severity"))


def pl_confidence(numbers: DataFrame, questions: DataFrame) -> DataFrame:
    q = questions.groupBy(L).agg(F.count_if("asked").alias("asked"),
                                 F.count_if(F.col("severity") == "critical").alias("critical"))
    asked, critical = F.coalesce("asked", F.lit(0)), F.coalesce("critical", F.lit(0))
    return numbers.join(q, L, "left").select(
        L, asked.alias("questions"), critical.alias("concerns"),
        F.when(asked > 0, "medium_confidence").when(critical > 0, "high_confidence_concerns")
        .when(F.col("revenue") == 0, "low_confidence").otherwise("high_confidence_clean").alias("label"))


# --- drill-downs -----------------------------------------------------------------


def _slice(gl: DataFrame, account: str, start: str, end: str) -> DataFrame:
    return gl.filter((F.col("account_name") == account) & in_period(start, end))


def _money(c: Column, name: str) -> Column:
    return F.round(c, 2).cast("double").alias(name)


def acct_summary(gl: DataFrame, account: str, start: str, end: str) -> DataFrame:
    return _slice(gl, account, start, end).groupBy(L, "account_name").agg(
        _money(F.sum(DR()), "total_debit"), _money(F.sum(CR()), "total_credit"),
        _money(F.sum(DR() - CR()), "net_dr_cr"), F.count(F.lit(1)).alias("entry_count"))


def acct_compare(gl: DataFrame, account: str, start: str, end: str) -> DataFrame:
    p0, p1 = prior_period(start, end)
    agg = gl.filter((F.col("account_name") == account) & in_period(p0, end)).groupBy(L).agg(
        total_if(in_period(p0, p1), DR() - CR()).alias("p"), total_if(in_period(start, end), DR() - CR()).alias("c"))
    var = F.col("c") - F.col("p")
    pct = F.when(F.col("p") != 0, F.round(var.cast("double") / F.abs("p").cast("double") * 100, 4))
    return agg.select(L, _money(F.col("p"), "prior_net"), _money(F.col("c"), "current_net"), _money(var, "variance"),
                      pct.alias("variance_pct"))


def acct_top_entries(gl: DataFrame, account: str, start: str, end: str, k: int = 5) -> DataFrame:
    amount = F.greatest(DR(), CR())
    rows = _slice(gl, account, start, end).withColumn("amount", amount)
    top = top_per(rows, [L], [F.col("amount").desc(), F.col("row_id")], k)
    return top.select(L, "row_id", "transaction_date", "reference_number", "voucher_type",
                      F.col("amount").cast("double").alias("amount"), "description")


def acct_by_voucher(gl: DataFrame, account: str, start: str, end: str) -> DataFrame:
    return _slice(gl, account, start, end).groupBy(L, "voucher_type").agg(
        F.count(F.lit(1)).alias("count"), _money(F.sum(DR()), "total_debit"), _money(F.sum(CR()), "total_credit"))


def acct_find(gl: DataFrame, pattern: str, start: str, end: str) -> DataFrame:
    return gl.filter(F.lower("account_name").like(pattern.lower()) & in_period(start, end)).groupBy(
        L, "account_name").agg(F.count(F.lit(1)).alias("entry_count"), _money(F.sum(DR()), "total_debit"),
                               _money(F.sum(CR()), "total_credit"))


def claim_check(claims: DataFrame, results: DataFrame, on: list[str], tolerance: float = 0.005) -> DataFrame:
    """Compare ``claimed`` in claims with ``actual`` in results on the given keys."""
    joined = claims.join(results, on, "left")
    ok = F.abs(F.col("claimed") - F.col("actual")) <= tolerance
    return joined.withColumn("verified", F.coalesce(ok, F.lit(False)))
