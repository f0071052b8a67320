"""Maintained rollups of the ledger: mergeable day states, rebuilt only for months whose files changed.

Three tables answer the checks, the account reconciliations, the flux and the
readiness without another pass over the postings (duplicates, whose keys are as
many as the postings, read them in the period):

* ``accounts``: sums a (ledger, account, voucher type, attribution, day);
* ``vouchers``: sums a (ledger, reference, day, party, voucher type);
* ``days``: the calendar of each ledger.

Sums, counts and flags merge, and every state carries its day, so any period is
a merge of states.  Texts are keys, never maxima: building is hash aggregation.
A slot of the store is a month; undated rows have their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import CR, DR, low, total_if
from ..sources.versioned import SLOT, VersionedTables

L, DAY = "ledger_id", "transaction_date"
# fixed values: the standard voucher types a full period holds
STANDARD_TYPES = ["sales", "purchase", "receipt", "payment"]
TAXES = ["cgst", "sgst", "igst"]


def _filled(*columns: str) -> Column:
    return F.coalesce(F.coalesce(*columns) != "", F.lit(False))


def voucher_flags() -> dict[str, Column]:
    """Whether a row makes its voucher one with tax deducted, or one that pays a vendor."""
    account = low("account_name")
    return {"has_tds": account.contains("tds"),
            "pays_vendor": account.contains("creditor") | low("voucher_type").rlike("purchase|payment|pur|bp")}


def account_days(gl: DataFrame) -> DataFrame:
    return gl.groupBy(
        L, "account_name", "account_group", low("voucher_type").alias("vt"),
        _filled("vendor_name", "party_name").alias("has_vendor"), _filled("vendor_name").alias("vendor_col"),
        _filled("customer_name", "party_name").alias("has_customer"), _filled("customer_name").alias("customer_col"),
        F.col("reference_number").isNotNull().alias("has_ref"), DAY,
    ).agg(F.count(F.lit(1)).alias("entries"), F.sum(DR()).alias("dr"), F.sum(CR()).alias("cr"))


VOUCHER = [L, "reference_number", DAY, "party_name", "voucher_type"]


def voucher_postings(gl: DataFrame) -> DataFrame:
    """What a voucher state needs of a posting, narrow enough to travel: flags in place of names."""
    account = low("account_name")
    flags = {**{t: account.contains(t) for t in TAXES}, **voucher_flags()}
    return gl.filter(F.col("reference_number").isNotNull()).select(
        *VOUCHER, DR().alias("dr"), CR().alias("cr"), *[hit.alias(name) for name, hit in flags.items()])


def voucher_sums(postings: DataFrame, *more: str) -> DataFrame:
    """States of ``voucher_postings``; ``more``: columns that a voucher decides, kept as keys."""
    size = F.abs(F.col("cr") - F.col("dr"))
    return postings.groupBy(*VOUCHER, *more).agg(
        F.sum("dr").alias("dr"), F.sum("cr").alias("cr"), *[total_if(F.col(t), size).alias(t) for t in TAXES],
        *[F.bool_or(name).alias(name) for name in voucher_flags()])


def voucher_days(gl: DataFrame) -> DataFrame:
    return voucher_sums(voucher_postings(gl))


def calendar_days(gl: DataFrame) -> DataFrame:
    kind = low("voucher_type")
    return gl.groupBy(L, DAY).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(DR() + CR()).alias("amount"), F.count_if((DR() == 0) & (CR() == 0)).alias("zeroes"),
        *[F.bool_or(kind.contains(t)).alias(f"has_{t}") for t in STANDARD_TYPES])


STATES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "accounts": account_days, "vouchers": voucher_days, "days": calendar_days}


def month_of(day: str = DAY) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))


@dataclass(frozen=True)
class Rollups:
    """Stands in for the ledger in checks, flux and reconciliations.  ``gl`` is the ledger itself, for the few that need postings."""

    gl: DataFrame
    accounts: DataFrame
    vouchers: DataFrame
    days: DataFrame

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Rollups:
        return Rollups(*[change(getattr(self, f.name)) for f in fields(self)])

    def withColumn(self, name: str, value: Column) -> Rollups:
        return self.each(lambda df: df.withColumn(name, value))

    def within(self, start: str, end: str) -> Rollups:
        """Only the months that a period touches, of the states whose other months it never needs."""
        inside = F.col(SLOT).between(start[:7], end[:7])
        return Rollups(self.gl, self.accounts, self.vouchers.filter(inside), self.days)

    # --- merges: what a pass over the ledger would give -------------------------

    def by_account(self, in_period: Column, upto: Column) -> DataFrame:
        zero = F.lit(0)
        return self.accounts.groupBy(L, "account_name", "account_group").agg(
            F.max("p_end").alias("p_end"), F.sum(F.when(in_period, F.col("entries")).otherwise(zero)).alias("entries"),
            total_if(in_period, F.col("dr")).alias("dr"), total_if(in_period, F.col("cr")).alias("cr"),
            total_if(upto, F.col("dr") - F.col("cr")).alias("balance"), F.max(F.when(upto, F.col(DAY))).alias("last_txn")).groupBy(
            L, "account_name").agg(
            F.max("account_group").alias("account_group"), F.max("p_end").alias("p_end"), F.sum("entries").alias("entries"),
            *[F.sum(c).alias(c) for c in ("dr", "cr", "balance")], F.max("last_txn").alias("last_txn"))

    def by_attribution(self, in_period: Column, upto: Column) -> DataFrame:
        net = F.col("dr") - F.col("cr")
        keys = [L, "account_name", "vt", "has_vendor", "vendor_col", "has_customer", "customer_col", "has_ref"]
        sums = {"dr_p": (in_period, F.col("dr")), "cr_p": (in_period, F.col("cr")), "net_p": (in_period, net), "net_e": (upto, net)}
        return self.accounts.groupBy(*keys, "account_group").agg(*[total_if(c, v).alias(k) for k, (c, v) in sums.items()]).groupBy(*keys).agg(
            F.max("account_group").alias("account_group"), *[F.sum(k).alias(k) for k in sums])

    def by_voucher(self, in_period: Column) -> DataFrame:
        return self.vouchers.filter(in_period).groupBy(L, "reference_number").agg(
            F.max(DAY).alias("day"), F.max("party_name").alias("party"), F.max("voucher_type").alias("voucher_type"),
            *[F.sum(c).alias(c) for c in ("dr", "cr", *TAXES)], *[F.bool_or(c).alias(c) for c in ("has_tds", "pays_vendor")])

    def by_period(self, now: Column, before: Column, either: Column) -> DataFrame:
        """Both periods of every named account."""
        net, zero = F.col("dr") - F.col("cr"), F.lit(0)
        named = self.accounts.filter(either & (F.coalesce("account_name", F.lit("")) != ""))
        counts = {"n_now": now, "n_before": before}
        return named.groupBy(L, "account_name", "account_group").agg(
            total_if(now, net).alias("current"), total_if(before, net).alias("prior"),
            *[F.sum(F.when(c, F.col("entries")).otherwise(zero)).alias(k) for k, c in counts.items()]).groupBy(L, "account_name").agg(
            F.max("account_group").alias("account_group"), *[F.sum(c).alias(c) for c in ("current", "prior", *counts)])

    def chart(self) -> DataFrame:
        """The distinct accounts with the group they post under."""
        named = self.accounts.filter(F.col("account_name").isNotNull() & (F.col("account_name") != ""))
        return named.select(L, "account_name", "account_group").distinct().groupBy(L, "account_name").agg(
            F.max("account_group").alias("account_group"))

    def ledgers(self) -> DataFrame:
        return self.days.select(L).distinct()


def _typed(gl: DataFrame) -> dict[str, str]:
    """Column types of the state tables, as the store reads them back."""
    return {name: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in build(gl).schema.fields) for name, build in STATES.items()}


#: Postings whose voucher states one task makes; months that hold more are cut into slices.
TASK_POSTINGS = 1_000_000
SLICE = "slice"


def _slots(gl: DataFrame, slices: int, sizes: dict[str, int]) -> dict[str, DataFrame]:
    """The states with their slot, a month in ``slices`` files or more; ``sizes``: the postings of each month.

    Vouchers are nearly as many as postings, so they travel once: postings go to the task that writes their slot and slice,
    and are summed there.  The other states shrink before they travel.
    """
    slices = max([slices, *[-(-n // TASK_POSTINGS) for n in sizes.values()]])
    tasks = max(int(gl.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // TASK_POSTINGS))

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumns({SLOT: month_of(), SLICE: F.pmod(F.xxhash64(L, df.columns[1]), F.lit(slices))})

    vouchers = voucher_sums(cut(voucher_postings(gl)).repartition(tasks, SLOT, SLICE), SLOT, SLICE)
    vouchers = vouchers.select(*[c for c in vouchers.columns if c not in (SLOT, SLICE)], SLOT).sortWithinPartitions(SLOT, L)
    states = {name: cut(make(gl)).repartition(SLOT, SLICE).drop(SLICE).sortWithinPartitions(SLOT, L)
              for name, make in STATES.items() if name != "vouchers"}
    return {name: vouchers if name == "vouchers" else states[name] for name in STATES}


def _sizes(gl: DataFrame) -> dict[str, int]:
    """Postings of each month: a calendar."""
    return {r[0]: r[1] for r in gl.groupBy(month_of().alias(SLOT)).count().collect()}


def _store(spark: SparkSession, path: str) -> VersionedTables:
    return VersionedTables(spark, path, STATES)


def load(spark: SparkSession, path: str, gl: DataFrame) -> Rollups:
    """The rollups kept under ``path``; ``gl``: the ledger they stand for, excluded rows dropped."""
    store = _store(spark, path)
    return Rollups(gl, **{name: store.read(name, kinds) for name, kinds in _typed(gl).items()})


def build(gl: DataFrame, path: str, slices: int = 1) -> Rollups:
    """All states of a ledger, written anew; raise ``slices`` where a month holds much."""
    sizes = _sizes(gl)
    store = _store(gl.sparkSession, path)
    store.replace(_slots(gl, slices, sizes), {m: "built" for m in sizes}, drop=store.manifest().slots)
    return load(gl.sparkSession, path, gl)


def file_stamps(ledger: DataFrame) -> dict[str, str]:
    """Month -> stamp of its files (paths, sizes, times).  Reads file footers and the partition column, no posting."""
    files = ledger.select("month", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    stamp = F.xxhash64("file_path", "file_size", "file_modification_time")
    rows = files.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(stamp).alias("stamp")).collect()
    return {r.month: f"{r.n}:{r.stamp}" for r in rows}


def refresh(spark: SparkSession, ledger_path: str, path: str, slices: int = 1) -> list[str]:
    """Bring the store up to a ledger written by ``sink_gl``; returns the months that were rebuilt.

    Months whose files are as they were are neither read nor written; months that vanished end.  A run that dies before its
    manifest is written has changed nothing, and the next one does the same work.
    """
    ledger = spark.read.parquet(ledger_path)
    now, store = file_stamps(ledger), _store(spark, path)
    held = store.manifest().slots
    changed = sorted(m for m, stamp in now.items() if m not in held or held[m][1] != stamp)
    gone = [m for m in held if m not in now]
    if changed or gone:
        rows = ledger.filter(F.col("month").isin(changed) & ~F.coalesce("excluded", F.lit(False)))
        store.replace(_slots(rows, slices, _sizes(rows)) if changed else {}, {m: now[m] for m in changed}, drop=gone)
    return changed
