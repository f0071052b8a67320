"""Data-quality checks over the ledger.

Every check yields Issue rows ``(ledger_id, code, severity, category, title,
affected_rows, exposure, detail)``, at most one per ledger and code.  Counts
and exposure cover all affected rows.  The checks share four passes over the
ledger (by account, by voucher, by day, by duplicate key); a full scan reads
the ledger four times, not once per check, and once (for duplicates, in the
period) where ``Rollups`` stand in for it.  The rows behind an issue come from
``account_findings`` / ``voucher_findings`` / ``duplicate_refs`` as tables,
since a set of references has no size bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import CR, DR, any_party, keyword_any, low, top_per, total_if
from .accounts import with_account_type
from .rollups import STANDARD_TYPES, Rollups

L = "ledger_id"
ISSUE = [L, "code", "severity", "category", "title", "affected_rows", "exposure", "detail"]
SEVERITY_RANK = {"critical": 0, "review": 1, "info": 2}

# fixed values: tolerances
DUP_DAYS, DUP_MIN_AMOUNT = 7, 100
OUTLIER_BEFORE, OUTLIER_AFTER = 60, 30
TDS_VOUCHER_LIMIT = 30000
STALE_DAYS, VERY_STALE_DAYS = 60, 90

ACCOUNT_CODES = ["trial_balance_mismatch", "unclassified_accounts", "sign_anomalies", "debtors_overdue"]
VOUCHER_CODES = ["voucher_imbalance", "gst_mismatch", "tds_potentially_missed"]
DAY_CODES = ["date_outliers", "missing_fields", "period_completeness"]
# the ten checks of one scan (voucher_imbalance is the older check, run on its own or by the gates)
SCAN_CODES = ["trial_balance_mismatch", "duplicate_transactions", "date_outliers", "missing_fields",
              "unclassified_accounts", "gst_mismatch", "sign_anomalies", "period_completeness",
              "tds_potentially_missed", "debtors_overdue"]

P0, P1 = "p_start", "p_end"
#: What a check reads: the postings, or the rollups kept for them.
Ledger = DataFrame | Rollups


def with_period(gl: Ledger, start: str, end: str) -> Ledger:
    """The same period for every ledger."""
    if isinstance(gl, Rollups):
        gl = gl.within(start, end)
    return (gl.withColumn(P0, F.lit(start).cast("date")).withColumn(P1, F.lit(end).cast("date")))


def with_recent_period(gl: Ledger, days: int = 90) -> Ledger:
    """Per ledger: the last ``days`` days of its own data."""
    dated = gl.days if isinstance(gl, Rollups) else gl
    last = dated.groupBy(L).agg(F.max("transaction_date").alias(P1)).withColumn(P0, F.date_sub(P1, days))
    return gl.each(lambda df: df.join(last, L)) if isinstance(gl, Rollups) else gl.join(last, L)


def _in_period() -> Column:
    return F.col("transaction_date").between(F.col(P0), F.col(P1))


def _stack(agg: DataFrame, candidates: Sequence[tuple[Column, ...]]) -> DataFrame:
    """Turn per-ledger columns into Issue rows: (when, code, severity, category, title, rows, exposure, detail)."""
    entries = [
        F.when(cond, F.struct(
            F.lit(code).alias("code"), severity.alias("severity"), F.lit(category).alias("category"),
            title.alias("title"), rows.cast("bigint").alias("affected_rows"),
            F.round(exposure.cast("double"), 2).alias("exposure"), detail.cast("string").alias("detail")))
        for cond, code, severity, category, title, rows, exposure, detail in candidates
    ]
    return agg.select(L, F.explode(F.array_compact(F.array(*entries))).alias("i")).select(L, "i.*").select(*ISSUE)


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


NONE = lambda: F.lit(None)


# --- pass 1: by account --------------------------------------------------------


def account_findings(gl: Ledger, overrides: DataFrame | None = None) -> DataFrame:
    """One row per ledger and account with its in-period and to-date figures and flags."""
    upto = F.col("transaction_date") <= F.col(P1)
    rolled = gl.by_account(_in_period(), upto) if isinstance(gl, Rollups) else gl.groupBy(L, "account_name").agg(
        F.max("account_group").alias("account_group"), F.max(P1).alias(P1),
        F.count_if(_in_period()).alias("entries"),
        total_if(_in_period(), DR()).alias("dr"), total_if(_in_period(), CR()).alias("cr"),
        total_if(upto, DR() - CR()).alias("balance"),
        F.max(F.when(upto, F.col("transaction_date"))).alias("last_txn"))
    named = F.coalesce(F.col("account_name") != "", F.lit(False))
    kind = F.when(named, F.col("account_type")).otherwise("UNKNOWN")
    stale_before = F.date_sub(P1, STALE_DAYS)
    owed = (F.col("balance") > 1000) & (F.col("last_txn") < stale_before)
    return (
        with_account_type(rolled, overrides)
        .withColumn("named", named)
        .withColumn("kind", kind)
        .withColumn("off", named & (F.abs(F.col("dr") - F.col("cr")) > 0.01))
        .withColumn("unclassified", named & (F.col("entries") > 0) & (F.col("kind") == "UNKNOWN"))
        .withColumn("odd_sign", ((F.col("kind") == "PAYABLE") & (F.col("balance") > 100))
                    | ((F.col("kind") == "RECEIVABLE") & (F.col("balance") < -100)))
        .withColumn("stale", owed)
        .withColumn("very_stale", owed & (F.col("last_txn") < F.date_sub(P1, VERY_STALE_DAYS)))
        .withColumn("looks_receivable", keyword_any(["account_name"], ["debtor", "receivable"])))


def _account_issues(gl: Ledger, codes: Sequence[str], overrides: DataFrame | None) -> DataFrame:
    acct = account_findings(gl, overrides)
    mapped = F.col("kind") == "RECEIVABLE"

    def pair(flag: Column, amount: Column, name: str) -> list[Column]:
        return [F.count_if(flag).alias(f"{name}_n"), total_if(flag, amount).alias(f"{name}_x")]

    agg = acct.groupBy(L).agg(
        F.abs(F.sum(F.col("dr") - F.col("cr"))).alias("gap"), F.count_if("off").alias("off_n"),
        *pair(F.col("unclassified"), F.col("dr") + F.col("cr"), "unc"),
        *pair(F.col("odd_sign"), F.abs("balance"), "sign"),
        F.max(mapped).alias("has_map"),
        *pair(F.col("stale") & mapped, F.col("balance"), "ms"), F.max(F.col("very_stale") & mapped).alias("ms_old"),
        *pair(F.col("stale") & F.col("looks_receivable"), F.col("balance"), "ns"),
        F.max(F.col("very_stale") & F.col("looks_receivable")).alias("ns_old"))

    def owed(suffix: str) -> Column:
        # mapped receivable accounts where the ledger has any, else accounts named like one
        return F.when(F.col("has_map"), F.col(f"ms_{suffix}")).otherwise(F.col(f"ns_{suffix}"))

    review, info, critical = F.lit("review"), F.lit("info"), F.lit("critical")
    table = {
        "trial_balance_mismatch": (
            F.col("gap") >= 1, "trial_balance_mismatch", critical, "Data Integrity",
            F.lit("Trial balance is off"), F.col("off_n"), F.col("gap"), NONE()),
        "unclassified_accounts": (
            F.col("unc_n") > 0, "unclassified_accounts", info, "Configuration",
            _counted(F.col("unc_n"), "unclassified account", "unclassified accounts"),
            F.col("unc_n"), F.col("unc_x"), NONE()),
        "sign_anomalies": (
            F.col("sign_n") > 0, "sign_anomalies", review, "Subledger",
            _counted(F.col("sign_n"), "account with unusual sign", "accounts with unusual sign"),
            F.col("sign_n"), F.col("sign_x"), NONE()),
        "debtors_overdue": (
            owed("n") > 0, "debtors_overdue", F.when(owed("old"), "critical").otherwise("review"), "Receivables",
            _counted(owed("n"), "debtor with no recovery in 60+ days", "debtors with no recovery in 60+ days"),
            owed("n"), owed("x"), NONE()),
    }
    return _stack(agg, [table[c] for c in codes])


# --- pass 2: by voucher --------------------------------------------------------


def voucher_findings(gl: Ledger) -> DataFrame:
    """One row per in-period voucher with its totals and flags."""
    acct, kind = low("account_name"), low("voucher_type")
    size = F.abs(CR() - DR())
    rolled = gl.by_voucher(_in_period()) if isinstance(gl, Rollups) else gl.filter(
            _in_period() & F.col("reference_number").isNotNull()).groupBy(L, "reference_number").agg(
        F.max("transaction_date").alias("day"), F.max("party_name").alias("party"),
        F.max("voucher_type").alias("voucher_type"),
        F.sum(DR()).alias("dr"), F.sum(CR()).alias("cr"),
        *[total_if(acct.contains(t), size).alias(t) for t in ("cgst", "sgst", "igst")],
        F.bool_or(acct.contains("tds")).alias("has_tds"),
        F.bool_or(acct.contains("creditor") | kind.rlike("purchase|payment|pur|bp")).alias("pays_vendor"))
    return (
        rolled.withColumn("amount", F.greatest("dr", "cr"))
        .withColumn("diff", F.abs(F.col("dr") - F.col("cr")))
        .withColumn("gst_diff", F.abs(F.col("cgst") - F.col("sgst")))
        .withColumn("unbalanced", (F.col("diff") > 0.01) & (F.col("reference_number") != ""))
        .withColumn("gst_off", (F.col("cgst") > 0) & (F.col("sgst") > 0) & (F.col("igst") == 0)
                    & (F.col("gst_diff") > 0.01))
        .withColumn("tds_missed", (F.col("amount") > TDS_VOUCHER_LIMIT) & (F.coalesce("party", F.lit("")) != "")
                    & F.col("pays_vendor") & ~F.col("has_tds") & (F.col("reference_number") != "")))


def _voucher_issues(gl: Ledger, codes: Sequence[str]) -> DataFrame:
    v = voucher_findings(gl)
    flags = {"voucher_imbalance": ("unbalanced", "diff"), "gst_mismatch": ("gst_off", "gst_diff"),
             "tds_potentially_missed": ("tds_missed", "amount")}
    agg = v.groupBy(L).agg(*[
        c for code in codes for c in (
            F.count_if(flags[code][0]).alias(f"{code}_n"),
            total_if(F.col(flags[code][0]), F.col(flags[code][1])).alias(f"{code}_x"))])
    text = {
        "voucher_imbalance": ("critical", "Data Integrity", "voucher where Debit ≠ Credit",
                              "vouchers where Debit ≠ Credit"),
        "gst_mismatch": ("review", "Indian SME", "voucher where CGST ≠ SGST", "vouchers where CGST ≠ SGST"),
        "tds_potentially_missed": ("review", "Tax Compliance", "vendor payment above ₹30,000 with no TDS deducted",
                                   "vendor payments above ₹30,000 with no TDS deducted"),
    }
    return _stack(agg, [
        (F.col(f"{c}_n") > 0, c, F.lit(text[c][0]), text[c][1], _counted(F.col(f"{c}_n"), *text[c][2:]),
         F.col(f"{c}_n"), F.col(f"{c}_x"), NONE()) for c in codes])


# --- pass 3: by day ------------------------------------------------------------

def day_findings(gl: Ledger) -> DataFrame:
    """One row per ledger and date (a NULL date included); as small as a calendar."""
    if isinstance(gl, Rollups):
        return gl.days
    kind = low("voucher_type")
    return gl.groupBy(L, "transaction_date").agg(
        F.max(P0).alias(P0), F.max(P1).alias(P1),
        F.count(F.lit(1)).alias("entries"), F.sum(DR() + CR()).alias("amount"),
        F.count_if((DR() == 0) & (CR() == 0)).alias("zeroes"),
        *[F.bool_or(kind.contains(t)).alias(f"has_{t}") for t in STANDARD_TYPES])


def weekdays_between(start: Column, end: Column) -> Column:
    return F.size(F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5))


def _day_issues(gl: Ledger, codes: Sequence[str]) -> DataFrame:
    date = F.col("transaction_date")
    outside = (date < F.date_sub(P0, OUTLIER_BEFORE)) | (date > F.date_add(P1, OUTLIER_AFTER))
    inside = _in_period()
    agg = day_findings(gl).groupBy(L).agg(
        F.max(P0).alias(P0), F.max(P1).alias(P1),
        total_if(outside, F.col("entries")).alias("out_n"), total_if(outside, F.col("amount")).alias("out_x"),
        total_if(date.isNull(), F.col("entries")).alias("no_date"),
        total_if(date.isNull() | inside, F.col("zeroes")).alias("zeroes"),
        F.count_if(inside).alias("active"), F.count_if(inside & (F.weekday(date) < 5)).alias("active_weekdays"),
        total_if(inside, F.col("entries")).alias("entries"),
        F.min(date).alias("first"), F.max(date).alias("last"),
        *[F.bool_or(inside & F.col(f"has_{t}")).alias(f"has_{t}") for t in STANDARD_TYPES])
    agg = agg.withColumn("weekdays", weekdays_between(F.col(P0), F.col(P1)))
    missing = sum((F.when(F.col(f"has_{t}"), 0).otherwise(1) for t in STANDARD_TYPES), F.lit(0))
    span = F.datediff("last", "first")
    per_weekday = F.try_divide(F.col("entries"), F.col("weekdays"))
    concerns = F.array_compact(F.array(
        F.when(F.try_divide(F.col("active_weekdays"), F.col("weekdays")) < 0.4, "low_coverage"),
        F.when(missing >= 3, "missing_voucher_types"),
        F.when((F.col("weekdays") >= 20) & (per_weekday < 2), "very_light_activity"),
        F.when((span > F.datediff(P1, P0) * 1.5) & (span > 90), "wider_data_range")))
    empty = F.col("active") == 0
    agg = agg.withColumn("concerns", F.when(empty, F.array(F.lit("no_transactions"))).otherwise(concerns))
    n = F.when(empty, 0).otherwise(F.size("concerns"))
    bad = F.col("no_date") + F.col("zeroes")
    table = {
        "date_outliers": (
            F.col("out_n") > 0, "date_outliers", F.lit("review"), "Data Integrity",
            _counted(F.col("out_n"), "entry dated outside the period", "entries dated outside the period"),
            F.col("out_n"), F.col("out_x"), NONE()),
        "missing_fields": (
            bad > 0, "missing_fields", F.lit("critical"), "Data Integrity",
            _counted(bad, "entry with missing critical fields", "entries with missing critical fields"),
            bad, NONE(), NONE()),
        "period_completeness": (
            F.size("concerns") > 0, "period_completeness",
            F.when(empty | F.array_contains("concerns", "missing_voucher_types"), "critical").otherwise("review"),
            "Period Validity",
            F.when(empty, "Period has no transactions").when(n == 1, "Period coverage looks off")
            .otherwise("Period coverage looks incomplete"),
            n, NONE(), F.array_join("concerns", ",")),
    }
    return _stack(agg, [table[c] for c in codes])


# --- pass 4: duplicates --------------------------------------------------------

KEY = [L, "party", "amount"]


def _dup_rows(gl: Ledger) -> DataFrame:
    """Rows that can take part in a pair, counted per (key, day, reference)."""
    gl = gl.gl if isinstance(gl, Rollups) else gl
    amount = F.greatest(DR(), CR())
    return (
        gl.filter(_in_period() & (amount > DUP_MIN_AMOUNT) & F.col("reference_number").isNotNull())
        .select(L, any_party().alias("party"), amount.alias("amount"), F.col("reference_number").alias("ref"),
                F.col("transaction_date").alias("day"))
        .filter(F.col("party").isNotNull())
        .groupBy(*KEY, "day", "ref").agg(F.count(F.lit(1)).alias("n")))


def _pairs_within(days: DataFrame, keys: list[str]) -> Column:
    """Row pairs at most seven days apart that end on this day, by running counts."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-DUP_DAYS, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    return F.col("n") * before + F.col("n") * (F.col("n") - 1) / 2


def _pair_counts(gl: Ledger) -> DataFrame:
    """Pairs per key: all pairs less pairs of one reference; no pair is ever built.

    The window only sees per-day counts, so even a key with a third of all rows
    brings at most one row per day of the period to a task.
    """
    rows = _dup_rows(gl)
    per_day = rows.groupBy(*KEY, "day").agg(F.sum("n").alias("n"))
    every = per_day.withColumn("pairs", _pairs_within(per_day, KEY))
    same = rows.withColumn("pairs", -_pairs_within(rows, [*KEY, "ref"]))
    return (
        every.select(*KEY, "pairs").unionByName(same.select(*KEY, "pairs"))
        .groupBy(*KEY).agg(F.sum("pairs").cast("bigint").alias("pairs")).filter("pairs > 0"))


def _duplicate_issues(gl: Ledger) -> DataFrame:
    agg = _pair_counts(gl).groupBy(L).agg(
        F.sum("pairs").alias("n"), F.sum(F.col("pairs") * F.col("amount")).alias("x"))
    return _stack(agg, [(
        F.col("n") > 0, "duplicate_transactions", F.lit("critical"), "Data Integrity",
        _counted(F.col("n"), "possible duplicate transaction", "possible duplicate transactions"),
        F.col("n"), F.col("x"), NONE())])


def _partners(gl: Ledger) -> DataFrame:
    """Each (key, day, ref) with the least and greatest reference within seven days of its key."""
    rows = _dup_rows(gl)
    per_day = rows.groupBy(*KEY, "day").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi"))
    w = Window.partitionBy(*KEY).orderBy(F.unix_date("day")).rangeBetween(-DUP_DAYS, DUP_DAYS)
    near = per_day.select(*KEY, "day", F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
    # one near row per (key, day): a hot day splits on the big side only
    return rows.join(near.filter("lo < hi"), [*KEY, "day"])


def duplicate_refs(gl: Ledger) -> DataFrame:
    """Every reference with a partner: same party and amount, other reference, within seven days."""
    hit = _partners(gl).filter((F.col("lo") < F.col("ref")) | (F.col("ref") < F.col("hi")))
    return hit.select(L, F.col("ref").alias("reference_number")).distinct()


def dup_pairs(gl: Ledger, k: int = 30) -> DataFrame:
    """The ``k`` largest duplicate pairs of each ledger, exactly, in linear work.

    Every left row with a later reference near it gives at least one pair, so
    the first k pairs start from the first k left rows; and one left row needs
    only its first k partners.
    """
    order = [F.col("amount").desc(), F.col("party"), F.col("ref"), F.col("day")]
    left = _partners(gl).filter(F.col("ref") < F.col("hi")).select(*KEY, "ref", "day", "n")
    left = top_per(left, [L], order, k).select(
        *KEY, F.col("ref").alias("vch_a"), F.col("day").alias("date_a"), F.col("n").alias("n_a"))
    pairs = _dup_rows(gl).join(left, KEY).filter(
        (F.col("vch_a") < F.col("ref")) & (F.abs(F.datediff("day", "date_a")) <= DUP_DAYS))
    pairs = top_per(pairs, [*KEY, "vch_a", "date_a"], [F.col("ref"), F.col("day")], k)
    # rows repeated under one reference and day pair off n_a * n times; at most k of them can show
    times = F.least(F.col("n_a") * F.col("n"), F.lit(k)).cast("int")
    pairs = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    final = [F.col("amount").desc(), F.col("party"), F.col("vch_a"), F.col("date_a"), F.col("ref"), F.col("day"),
             F.col("copy")]
    return top_per(pairs, [L], final, k).select(
        L, "party", F.col("amount").cast("double").alias("amount"), "vch_a", "date_a",
        F.col("ref").alias("vch_b"), F.col("day").alias("date_b"), "copy")


# --- public checks -------------------------------------------------------------


def run_checks(gl: Ledger, codes: Sequence[str], overrides: DataFrame | None = None) -> DataFrame:
    """Issues for ``codes`` over a ledger that carries its period columns."""
    parts = []
    for known, build in (
        (ACCOUNT_CODES, lambda c: _account_issues(gl, c, overrides)),
        (VOUCHER_CODES, lambda c: _voucher_issues(gl, c)),
        (DAY_CODES, lambda c: _day_issues(gl, c)),
        (["duplicate_transactions"], lambda c: _duplicate_issues(gl)),
    ):
        wanted = [c for c in codes if c in known]
        if wanted:
            parts.append(build(wanted))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check(code: str, gl: Ledger, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    return run_checks(with_period(gl, start, end), [code], overrides)


def sort_issues(issues: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "review", 1).otherwise(2)
    return issues.orderBy(L, rank, F.coalesce("exposure", F.lit(0.0)).desc(), "code")


def scan(gl: Ledger, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """All ten checks, worst first."""
    return sort_issues(run_checks(with_period(gl, start, end), SCAN_CODES, overrides))


def scan_totals(issues: DataFrame) -> DataFrame:
    """Per ledger: issue counts by severity and total exposure."""
    return issues.groupBy(L).agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
        F.round(F.sum(F.coalesce("exposure", F.lit(0.0)).cast("decimal(38,2)")), 2).cast("double")
        .alias("total_exposure"))


def scan_examples(gl: Ledger, start: str, end: str, overrides: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Up to five worst rows behind each issue, as (what, amount)."""
    gl = with_period(gl, start, end)
    acct, vch = account_findings(gl, overrides), voucher_findings(gl)
    a = acct.select(L, F.explode(F.array_compact(F.array(
        F.when(F.col("off"), F.struct(F.lit("trial_balance_mismatch").alias("code"), F.col("account_name").alias("what"),
                                      F.abs(F.col("dr") - F.col("cr")).cast("decimal(38,4)").alias("size"))),
        F.when(F.col("unclassified"), F.struct(F.lit("unclassified_accounts").alias("code"),
                                               F.col("account_name").alias("what"),
                                               (F.col("dr") + F.col("cr")).cast("decimal(38,4)").alias("size"))),
        F.when(F.col("odd_sign"), F.struct(F.lit("sign_anomalies").alias("code"), F.col("account_name").alias("what"),
                                           F.abs("balance").cast("decimal(38,4)").alias("size"))),
    ))).alias("e")).select(L, "e.*")
    v = vch.select(L, F.explode(F.array_compact(F.array(*[
        F.when(F.col(flag), F.struct(F.lit(code).alias("code"), F.col("reference_number").alias("what"),
                                     F.col(size).cast("decimal(38,4)").alias("size")))
        for code, flag, size in (("gst_mismatch", "gst_off", "gst_diff"),
                                 ("tds_potentially_missed", "tds_missed", "amount"))
    ]))).alias("e")).select(L, "e.*")
    worst = top_per(a.unionByName(v), [L, "code"], [F.col("size").desc(), F.col("what")], k)
    return worst.select(L, "code", "what", F.round(F.col("size"), 2).cast("double").alias("size"))


def affected_refs(gl: Ledger, start: str, end: str) -> DataFrame:
    """All voucher references behind the voucher-level issues, one row each."""
    gl = with_period(gl, start, end)
    by_voucher = voucher_findings(gl).select(L, "reference_number", F.explode(F.array_compact(F.array(
        F.when(F.col("gst_off"), F.lit("gst_mismatch")),
        F.when(F.col("tds_missed"), F.lit("tds_potentially_missed")),
        F.when(F.col("unbalanced"), F.lit("voucher_imbalance"))))).alias("code"))
    dup = duplicate_refs(gl).withColumn("code", F.lit("duplicate_transactions"))
    return by_voucher.unionByName(dup)


# --- checks of the standalone profile ------------------------------------------


def negative_bank(gl: DataFrame) -> DataFrame:
    """Bank and cash accounts below -1 over all time."""
    acct = F.lower("account_name")
    return (gl.filter(keyword_any(["account_name"], ["bank", "cash"])).groupBy(L, acct.alias("account_name"))
            .agg(F.sum(DR() - CR()).alias("b")).filter("b < -1")
            .select(L, "account_name", F.round("b", 2).cast("double").alias("balance")))


def date_outliers_pct(gl: DataFrame) -> DataFrame:
    """Rows dated outside [p5 - 30d, p95 + 30d] of their ledger, where it has over 20 dated rows.

    The percentiles are exact: they are read off running counts per day.
    """
    per_day = gl.filter(F.col("transaction_date").isNotNull()).groupBy(
        L, F.col("transaction_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(L)
    upto = w.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per_day.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(w))

    def nth(p: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("total") * F.lit(p)), F.col("day"))).over(w)

    bounded = ranked.withColumn("lo", F.date_sub(nth(0.05), 30)).withColumn("hi", F.date_add(nth(0.95), 30))
    return bounded.filter("total > 20").groupBy(L).agg(
        F.max("lo").alias("earliest"), F.max("hi").alias("latest"),
        F.sum(F.when((F.col("day") < F.col("lo")) | (F.col("day") > F.col("hi")), F.col("n")).otherwise(0))
        .alias("outliers"))


def company_profile(gl: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One wide row per ledger, all time."""
    vch = gl.filter(F.coalesce("reference_number", F.lit("")) != "").groupBy(L, "reference_number").agg(
        F.sum(DR()).alias("dr"), F.sum(CR()).alias("cr"))
    off = F.abs(F.col("dr") - F.col("cr"))
    vouchers = vch.groupBy(L).agg(
        F.count(F.lit(1)).alias("vouchers"), F.count_if(off > 0.01).alias("imbalanced_vouchers"),
        F.round(F.coalesce(F.sum(F.when(off > 0.01, off)), F.lit(0)), 2).cast("double").alias("imbalance_exposure"),
        F.round(F.sum("dr"), 2).cast("double").alias("total_debit"),
        F.round(F.sum("cr"), 2).cast("double").alias("total_credit"))
    acct = with_account_type(
        gl.filter(F.trim(F.coalesce("account_name", F.lit(""))) != "").groupBy(L, "account_name")
        .agg(F.max("account_group").alias("account_group")), overrides)
    accounts = acct.groupBy(L).agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("account_type") == "UNKNOWN").alias("unclassified"),
        F.count_distinct(F.when(F.col("account_type").isin("BANK", "PAYABLE", "RECEIVABLE", "TAX", "INVENTORY"),
                                F.col("account_type"))).alias("recon_categories"))
    size = F.when(DR() != 0, DR()).otherwise(CR())
    dup = gl.filter(F.col("transaction_date").isNotNull() & (F.coalesce("party_name", F.lit("")) != "") & (size != 0))
    dup = dup.groupBy(L, "transaction_date", "party_name", size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    dups = dup.groupBy(L).agg(F.sum(F.col("n") - 1).alias("duplicates"))
    party = gl.filter(F.trim(F.coalesce("party_name", F.lit(""))) != "").select(L, "party_name").distinct()
    parties = party.groupBy(L).agg(F.count(F.lit(1)).alias("parties"))
    rows = gl.groupBy(L).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if((F.coalesce("account_name", F.lit("")) == "") | ((DR() == 0) & (CR() == 0)))
        .alias("missing_fields"))
    bank = negative_bank(gl).groupBy(L).agg(F.count(F.lit(1)).alias("negative_banks"))
    out = rows
    for part in (vouchers, accounts, parties, dups, bank):
        out = out.join(part, L, "left")
    return out.fillna(0)


# --- across ledgers ------------------------------------------------------------


def recent_issues(gl: Ledger, overrides: DataFrame | None = None, days: int = 90) -> DataFrame:
    """A scan of each ledger over the last ``days`` days of its own data."""
    return run_checks(with_recent_period(gl, days), SCAN_CODES, overrides)


def scan_summary(issues: DataFrame, k: int = 5) -> DataFrame:
    """Issue codes over all ledgers by exposure, top five."""
    exposure = F.sum(F.coalesce("exposure", F.lit(0.0)).cast("decimal(38,2)"))
    return (issues.groupBy("code").agg(F.sum("affected_rows").alias("affected_rows"), F.count(F.lit(1)).alias("cards"),
                                       exposure.cast("double").alias("exposure"))
            .orderBy(F.col("exposure").desc(), "code").limit(k))


# fixed values: minutes by hand per affected row / per unit, and minutes of review
MANUAL_MINUTES = {
    "voucher_imbalance": 1.5, "duplicate_transactions": 0.8, "date_outliers": 1.0, "missing_fields": 0.6,
    "gst_mismatch": 2.0, "sign_anomalies": 3.0, "unclassified_accounts": 0.5,
}
MANUAL_PER_RECON, MANUAL_PER_CLOSE = 45, 30
REVIEW_PER_ISSUE, REVIEW_PER_AUTO, REVIEW_PER_RECON, REVIEW_PER_CLOSE = 2.0, 0.1, 0.5, 8
RECONS_PER_LEDGER = 4


def time_saved(issues: DataFrame, ledgers: DataFrame, auto_resolved: DataFrame | None = None) -> DataFrame:
    """Hours saved per ledger: work by hand less review, never below zero.

    ``ledgers`` has one row per ledger (a close cycle each); ``auto_resolved``
    optionally brings (ledger_id, auto_resolved).
    """
    rate = F.lit(0.0)
    for code, minutes in MANUAL_MINUTES.items():
        rate = F.when(F.col("code") == code, F.lit(minutes)).otherwise(rate)
    per = issues.groupBy(L).agg(
        F.sum(F.col("affected_rows") * rate).alias("by_hand"), F.count(F.lit(1)).alias("cards"))
    out = ledgers.select(L).distinct().join(per, L, "left")
    if auto_resolved is not None:
        out = out.join(auto_resolved, L, "left")
    else:
        out = out.withColumn("auto_resolved", F.lit(0))
    manual = F.coalesce("by_hand", F.lit(0.0)) + RECONS_PER_LEDGER * MANUAL_PER_RECON + MANUAL_PER_CLOSE
    review = (F.coalesce("cards", F.lit(0)) * REVIEW_PER_ISSUE
              + F.coalesce("auto_resolved", F.lit(0)) * REVIEW_PER_AUTO
              + RECONS_PER_LEDGER * REVIEW_PER_RECON + REVIEW_PER_CLOSE)
    return out.select(L, F.round(F.greatest(F.lit(0.0), manual - review) / 60, 4).alias("hours_saved"))
