"""Maintained rollups: equal to passes over the postings, refreshed by file, safe against half-done work."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checks as C
from ledgerloom.operators import flux as X
from ledgerloom.operators import recon as R
from ledgerloom.operators import rollups as U
from ledgerloom.plans.registry import Data
from ledgerloom.sources import files
from ledgerloom.sources.schema import conform
from ledgerloom.sources.versioned import VersionedTables

START, END = "2024-02-10", "2024-04-20"


def postings(spark, n=600, seed=1, first=0):
    rng = random.Random(seed)
    accounts = [("Bank", "Bank Accounts"), ("CGST Output", None), ("SGST Output", None), ("Sundry Creditor A", "Sundry Creditors"), ("Debtor B", "Sundry Debtors"),
                ("Sales", "Sales Accounts"), ("Mystery", None), ("Sales", None), (None, None), ("", None), ("TDS payable", None), ("Stock in Hand", "Stock-in-Hand")]
    rows = []
    for i in range(first, first + n):
        day = None if rng.random() < 0.03 else dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(150))
        name, group = rng.choice(accounts)
        amount = rng.choice(["0", "50", "150.25", "150.25", "40000", "999.99"])
        dr, cr = (amount, "0") if rng.random() < 0.5 else ("0", amount)
        rows.append((rng.choice([1, 1, 1, 2, 3]), f"r{i}", rng.choice([None, "", "v1", *[f"v{rng.randrange(120)}" for _ in range(9)]]), day, name, group,
                     rng.choice([None, "", "Asha", "Ravi"]), rng.choice([None, "V1"]), rng.choice([None, "C1"]),
                     rng.choice(["Sales", "Purchase", "Payment", "Receipt", "Journal", None]), dr, cr, rng.random() < 0.05))
    df = spark.createDataFrame(rows, "ledger_id int, row_id string, reference_number string, transaction_date date, account_name string, account_group string, "
                                     "party_name string, vendor_name string, customer_name string, voucher_type string, dr string, cr string, excluded boolean")
    df = df.withColumns({"debit_amount": F.col("dr").cast("decimal(20,4)"), "credit_amount": F.col("cr").cast("decimal(20,4)")}).drop("dr", "cr")
    return conform(df).withColumns({"net_amount": (F.col("debit_amount") - F.col("credit_amount")).cast("decimal(20,4)"),
                                    "excluded": F.coalesce("excluded", F.lit(False))})


def answers(gl):
    """Everything the rollups answer, as sorted rows."""
    parts = {"scan": C.scan(gl, START, END), "recent": C.recent_issues(gl), "imbalance": C.check("voucher_imbalance", gl, START, END),
             "refs": C.affected_refs(gl, START, END), "pairs": C.dup_pairs(C.with_period(gl, START, END)),
             "flux": X.flux(gl, START, END), "recons": R.recon_run(gl, START, END)}
    return {k: sorted(map(str, df.select(*sorted(df.columns)).collect())) for k, df in parts.items()}


@pytest.fixture(scope="module")
def gl(spark):
    return postings(spark).cache()


@pytest.fixture(scope="module")
def wanted(gl):
    return answers(gl.filter("NOT excluded"))


def test_rollups_equal_the_postings(gl, wanted, tmp_path):
    assert all(wanted.values())
    assert answers(U.build(gl.filter("NOT excluded"), str(tmp_path / "store"))) == wanted


def test_late_file_rebuilds_only_its_months(spark, gl, wanted, tmp_path):
    ledger, store = str(tmp_path / "gl"), str(tmp_path / "store")
    late = (F.col("transaction_date").between("2024-03-01", "2024-03-31") & (F.col("ledger_id") == 1)) | F.col("transaction_date").isNull()
    files.sink_gl(gl.filter(~F.coalesce(late, F.lit(True))), ledger)
    assert U.refresh(spark, ledger, store) == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"]
    before = VersionedTables(spark, store, U.STATES).manifest()
    files.sink_gl(gl.filter(F.coalesce(late, F.lit(True))), ledger, mode="append")
    assert U.refresh(spark, ledger, store) == ["2024-03", "none"]
    after = VersionedTables(spark, store, U.STATES).manifest()
    assert {m for m in after.slots if after.slots[m] != before.slots.get(m)} == {"2024-03", "none"}
    rows = spark.read.parquet(ledger).filter("NOT excluded").select(*[c for c in gl.columns])
    assert answers(U.load(spark, store, rows)) == wanted
    assert U.refresh(spark, ledger, store) == [] and VersionedTables(spark, store, U.STATES).manifest().change == after.change
    assert VersionedTables(spark, store, U.STATES).vacuum() > 0 and answers(U.load(spark, store, rows)) == wanted


def test_vanished_months_and_empty_ledgers(spark, gl, tmp_path):
    ledger, store = str(tmp_path / "gl"), str(tmp_path / "store")
    files.sink_gl(gl, ledger)
    U.refresh(spark, ledger, store)
    files.sink_gl(gl.filter("transaction_date < '2024-02-01'"), ledger)
    assert U.refresh(spark, ledger, store) == ["2024-01"]
    assert {r.slot for r in U.load(spark, store, gl).days.select("slot").distinct().collect()} == {"2024-01"}
    empty = U.build(gl.limit(0), str(tmp_path / "none"))
    assert C.scan(empty, START, END).count() == 0 and R.recon_run(empty, START, END).count() == 0


def test_half_done_work_is_invisible(spark, gl, tmp_path):
    """Files of a change whose manifest was never written do not count; doing it again does."""
    store = VersionedTables(spark, str(tmp_path / "t"), ["x"])
    one = spark.createDataFrame([("a", 1), ("b", 2)], "slot string, v int")
    store.replace({"x": one}, {"a": "s", "b": "s"})
    one.withColumns({"v": F.col("v") + 10, "version": F.lit("torn")}).write.mode("append").partitionBy("slot", "version").parquet(f"{store.path}/x")
    assert sorted(r.v for r in store.read("x", "v int").collect()) == [1, 2]
    store.replace({"x": one.filter("slot = 'a'").withColumn("v", F.lit(7))}, {"a": "t"}, drop=["b"])
    assert [r.v for r in store.read("x", "v int").collect()] == [7]
    store.replace({}, {}, drop=["a"])
    assert store.read("x", "v int").count() == 0 and store.manifest().change == 2
    assert store.read("nothing", "v int").columns == ["v", "slot"]


def scans(df, what):
    """How often a plan reads files whose path holds ``what``."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line and what in line for line in text.splitlines())


def test_ledger_is_read_at_most_three_times(spark, sf):
    import __spark_entry__ as entry

    data = Data(spark, sf)
    postings_columns = "debit_amount"
    assert data.rollups.gl.columns == data.gl.columns
    for name, most in (("scan", 2), ("recon_run", 1), ("readiness_score", 3)):
        assert scans(entry.queries()[name](spark, sf), postings_columns) <= most, name


def test_building_is_hash_aggregation(gl):
    for name, make in U.STATES.items():
        plan = make(gl)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and plan.count("Exchange") == 1, name
