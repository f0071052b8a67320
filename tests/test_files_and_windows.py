"""Dialects, ledger layout and duplicate windows against brute force."""

import datetime as dt
import random
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ledgerloom.operators import checks as C
from ledgerloom.operators import dup_windows as W
from ledgerloom.sources import files as S
from ledgerloom.sources.schema import conform

D0 = dt.date(2024, 4, 1)


def ledger(spark, rows):
    """rows: (ledger, ref, day, party, amount)"""
    df = spark.createDataFrame([(*r[:4], float(r[4]), f"r{i}") for i, r in enumerate(rows)],
                               "ledger_id int, reference_number string, transaction_date date, party_name string, a double, row_id string")
    money = F.col("a").cast("decimal(20,4)")
    return conform(df.select("ledger_id", "row_id", "reference_number", "transaction_date", "party_name", F.lit("Sales").alias("account_name"),
                             money.alias("debit_amount"), F.lit(0).cast("decimal(20,4)").alias("credit_amount"), money.alias("net_amount")))


def test_files_of_several_dialects(spark, tmp_path):
    folder = tmp_path / "a folder [1]"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2;3;4\n", encoding="utf-8")
    (folder / "b b%.csv").write_text("\ufeffy;x\n \"a;b\" ;5\n", encoding="utf-8")
    (folder / "c.csv").write_text('\n"x"\t"long, long, long, header; ' + "h," * 3000 + '"\n6\t7\n', encoding="utf-8")
    (tmp_path / "a folder 2").mkdir()
    (tmp_path / "a folder 2" / "d.csv").write_text('"x","two\nlines, with | marks"\n8,"9\n9"\n', encoding="utf-8")
    (folder / "e.csv").write_text("", encoding="utf-8")
    (folder / "f.csv").write_text("x,y\n10,11\n", encoding="utf-8")
    df = S.src_delimited(spark, str(tmp_path / "a folder*"))
    rows = {r["x"]: r.asDict() for r in df.collect()}
    assert set(rows) == {"1", "5", "6", "8", "10"} and len(df.columns) == 4
    assert rows["1"]["y"] == "2;3;4" and rows["5"]["y"] == "a;b" and rows["10"]["y"] == "11"
    assert rows["8"]["two\nlines, with | marks"] == "9\n9"
    assert [v for k, v in rows["6"].items() if k.startswith("long")] == ["7"]


def test_a_folder_without_records(spark, tmp_path):
    (tmp_path / "e.csv").write_text("\n \n", encoding="utf-8")
    df = S.src_delimited(spark, str(tmp_path))
    assert df.columns == [] and df.count() == 0


def test_no_file_exceeds_twice_the_median(spark, tmp_path):
    rows = [(i % 5, f"v{i}", D0 + dt.timedelta(days=i % 120), "p", 1) for i in range(2000)]
    rows += [(1, f"h{i}", D0, "p", 1) for i in range(1000)] + [(2, f"u{i}", None, "p", 1) for i in range(500)]
    gl = ledger(spark, rows)
    bound = int(gl.groupBy("ledger_id", F.date_format("transaction_date", "yyyy-MM")).count().agg(F.percentile_approx("count", 0.5)).first()[0])
    S.sink_gl(gl, str(tmp_path / "gl"), rows_per_file=bound)
    sizes = sorted(pq.read_metadata(f).num_rows for f in (tmp_path / "gl").rglob("*.parquet"))
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and sum(sizes) == len(rows)
    assert {tuple(r) for r in S.scan_gl(spark, str(tmp_path / "gl")).select("row_id", "transaction_date").collect()} == {
        tuple(r) for r in gl.select("row_id", "transaction_date").collect()}
    S.sink_gl(gl, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").rglob("*.parquet"))) == 21  # twenty ledger-months and the undated rows


def test_windows_expand_to_all_pairs_of_a_hot_key(spark):
    rng = random.Random(7)
    rows = [(1, f"v{rng.randint(0, 60)}", D0 + dt.timedelta(days=rng.choice([0, 0, 0, 3, 7, 8, 15, 40])), "hot", 500) for _ in range(200)]
    rows += [(rng.randint(1, 2), f"w{i % 17}", D0 + dt.timedelta(days=rng.randint(0, 30)), rng.choice("ab"), rng.choice([200, 300])) for i in range(120)]
    rows += [(1, None, D0, "hot", 500), (1, "x", None, "hot", 500), (1, "y", D0, "hot", 100)]
    gl = C.with_period(ledger(spark, rows), "2024-04-01", "2024-06-30")
    windows = W.dup_windows(gl).cache()
    want = Counter()
    ok = [r for r in rows if r[1] and r[2] and r[4] > 100]
    for i, a in enumerate(ok):
        for b in ok[i + 1:]:
            if a[0] == b[0] and a[3:] == b[3:] and a[1] != b[1] and abs((a[2] - b[2]).days) <= 7:
                x, y = sorted((a, b), key=lambda r: r[1])
                want[(x[0], x[3], float(x[4]), x[1], x[2], y[1], y[2])] += 1
    got = {tuple(r)[:-1]: r.pairs for r in W.expand(windows).collect()}
    assert got == dict(want)
    assert windows.agg(F.sum(F.col("copies") * F.col("partners"))).first()[0] == sum(want.values())
    assert windows.count() == len({(r[0], r[1], r[2], r[3], r[4]) for r in ok})
    issue = C.run_checks(gl, ["duplicate_transactions"]).agg(F.sum("affected_rows")).first()[0]
    assert issue == sum(want.values())
    one = W.expand(windows, windows.filter("party = 'a'"))
    assert {tuple(r)[:-1] for r in one.collect()} == {k for k in want if k[1] == "a"}
    assert W.dup_windows(gl.limit(0)).count() == 0
