"""Wide rows are neither sorted nor shuffled more than their job needs."""

import datetime as dt
import re
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import recon, rollups as U
from ledgerloom.operators.checks import with_period
from ledgerloom.plans import catalog, registry, schema_queries  # noqa: F401  the catalog first
from ledgerloom.sources import files, staging, trade_ledger
from ledgerloom.sources.schema import conform


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ledger(spark, n):
    """``n`` rows, two a voucher, in 3 ledgers and 40 months."""
    rows = [(i % 3, f"r{i}", dt.date(2020 + i % 40 // 12, 1 + i % 40 % 12, 1 + i % 28), f"v{i // 2}", "Bank", "Sales") for i in range(n)]
    df = spark.createDataFrame(rows, "ledger_id int, row_id string, transaction_date date, reference_number string, account_name string, voucher_type string")
    return conform(df.withColumns({c: F.lit(1).cast("decimal(20,4)") for c in ("debit_amount", "credit_amount", "net_amount")}).withColumn("excluded", F.lit(False)))


def test_staging_sorts_trade_rows_not_legs(spark, sf, monkeypatch):
    monkeypatch.setattr(registry, "staged", lambda spark, name, source, build: build())
    lines = plan(registry.Data(spark, sf).gl_all).splitlines()
    place = {kind: [i for i, line in enumerate(lines) if re.search(rf"\b{kind}\b", line)] for kind in ("Sort", "Generate")}
    assert len(place["Generate"]) == 2
    # a child stands below its parent: each sort by day lies under the legs made of its rows
    first, second = place["Generate"]
    assert any(first < i < second for i in place["Sort"]) and any(i > second for i in place["Sort"]) and min(place["Sort"]) > first
    assert not any("transaction_date" in lines[i] for i in place["Sort"])


def test_sorts_of_trade_rows_are_bounded(spark, sf, monkeypatch):
    # as many tasks as the rows need, not as many as cores or splits; every row once
    whole = trade_ledger.purchase_side(spark, sf).select("row_id")
    monkeypatch.setattr(staging, "TASK_ROWS", 100, raising=False)
    legs = trade_ledger.purchase_side(spark, sf).select("row_id")
    sizes = legs.groupBy(F.spark_partition_id()).count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    rows = trade_ledger.read(spark, sf, "lineitem").count()
    assert sizes["n"] >= rows / 200 and sizes["most"] < 2_500
    assert legs.exceptAll(whole).isEmpty() and legs.count() == whole.count()


def test_trade_rows_of_small_row_groups_are_split_not_shuffled(spark, tmp_path, monkeypatch):
    # more rows than the cores' tasks may hold, in row groups that a scan can part: read in finer splits, nothing dealt out
    n = 48_000
    spark.range(n).select("id", F.xxhash64("id").alias("h")).coalesce(1).sortWithinPartitions("h").write.option("parquet.block.size", 4_096).option(
        "parquet.page.size.row.check.min", 100).option("parquet.block.size.row.check.min", 100).parquet(str(tmp_path / "t"))
    monkeypatch.setattr(staging, "TASK_ROWS", 2_000)
    monkeypatch.setattr(staging, "_BUILT", {})
    held, openings = spark.conf.get(staging.SPLITS, None), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    seen = []

    def build():
        df = staging.spread(spark.read.parquet(str(tmp_path / "t")), "id")
        seen.append((plan(df).count("Exchange"), df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]))
        return df

    try:
        out = staging.staged(spark, "splits", str(tmp_path), build)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", openings)
    assert seen[0][0] == 0 and seen[0][1] <= 4_000
    assert out.count() == n and out.select("id").distinct().count() == n
    assert spark.conf.get(staging.SPLITS, None) == held


@pytest.mark.parametrize("step", [
    lambda d: schema_queries._cube(d, "cube"),
    lambda d: recon.account_rollup(with_period(d.gl, "2020-01-01", "2021-06-30"))], ids=["cube", "recon"])
def test_the_ledger_is_not_sorted_for_its_groups(spark, step):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan is shown before it runs
    try:
        data = SimpleNamespace(gl=ledger(spark, 200).withColumn("account_group", F.substring("row_id", -1, 1)), overrides=spark.createDataFrame(
            [], "ledger_id int, account_name string, account_type string, confidence double, is_confirmed boolean"))
        lines = plan(step(data)).splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # a child stands below its parent: the lowest aggregate, over the ledger's own rows, is by hash
    lowest = [line for line in lines if "Aggregate(" in line or "Aggregate [" in line][-1]
    assert "HashAggregate" in lowest and "ObjectHash" not in lowest


def test_vouchers_travel_once(spark):
    gl = ledger(spark, 200)
    vouchers = U._slots(gl, 1, U._sizes(gl))["vouchers"]
    assert plan(vouchers).count("Exchange hashpartitioning") == 1
    assert vouchers.drop("slot").exceptAll(U.voucher_days(gl)).count() == 0 and vouchers.count() == U.voucher_days(gl).count()


def test_months_are_cut_by_their_postings(spark, monkeypatch):
    gl = ledger(spark, 400)
    monkeypatch.setattr(U, "TASK_POSTINGS", 5)
    vouchers = U._slots(gl, 1, U._sizes(gl))["vouchers"].withColumn("task", F.spark_partition_id())
    assert vouchers.groupBy("slot").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] > 1
    assert vouchers.count() == U.voucher_days(gl).count()


def test_sink_has_as_many_tasks_as_its_rows_need(spark, tmp_path, monkeypatch):
    gl = ledger(spark, 600)
    monkeypatch.setattr(files, "TASK_ROWS", 10)
    files.sink_gl(gl, str(tmp_path / "gl"))
    tasks = {int(re.match(r"part-(\d+)", f.name)[1]) for f in Path(tmp_path / "gl").rglob("part-*.parquet")}
    assert max(tasks) >= 8  # more than the session's shuffle partitions
    assert files.scan_gl(spark, str(tmp_path / "gl")).exceptAll(gl).count() == 0
