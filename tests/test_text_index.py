"""The text index answers like a scan and reads only candidate blocks."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import text_index as X
from ledgerloom.operators.schema_intel import gl_search
from ledgerloom.sources.schema import conform


def ledger(spark, rows):
    """rows: (ledger, account, party, reference, description)"""
    df = spark.createDataFrame([(*r, f"r{i:06d}") for i, r in enumerate(rows)],
                               "ledger_id int, account_name string, party_name string, reference_number string, description string, row_id string")
    return conform(df.select("*", F.lit("2024-04-01").cast("date").alias("transaction_date")))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(3)
    names = ["Bank of Ünter", "Rent A/C", "Sales 18%", "ab", "", None, "TDS payable", "50%_off [x] (y)"]
    # account 0 holds a third of all rows
    rows = [(i % 4, f"Account {0 if i % 3 == 0 else i % 40}", rng.choice(names), f"V-{i}", rng.choice([None, "", "paid to Zed", "İstanbul fee"])) for i in range(3000)]
    gl = ledger(spark, rows)
    path = str(tmp_path_factory.mktemp("texts") / "index")
    return gl, path, X.build(gl, path, block_rows=100)


def ids(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


@pytest.mark.parametrize("text", ["bank of", "BANK OF ü", "v-17", "account 7", "50%_off [x]", "ab", "a", "zed", "nowhere at all", "paid to zedd"])
def test_equal_to_the_scan(made, text):
    gl, _, index = made
    assert ids(index.search(text)) == ids(gl_search(gl, text))


def test_filters_go_on(made):
    gl, _, index = made
    args = {"accounts": ["Account 0"], "after": (1, "r000500")}
    assert ids(index.search("bank", **args)) == ids(gl_search(gl, "bank", **args)) != []


def test_blocks_are_even_and_few_are_read(made):
    gl, path, index = made
    sizes = [r.n for r in index.blocks().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 200 and len(sizes) >= 20
    wanted = {(r[X.BATCH], r[X.BLOCK]) for r in index.candidates("v-1234").collect()}
    assert 1 <= len(wanted) <= 5
    found = index.search("v-1234")
    assert found.count() == 1
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text.lower()
    assert index.candidates("nowhere at all").count() == 0
    assert index.candidates("ab").count() == len(sizes)


def test_late_rows_are_appended_and_unlisted_blocks_unseen(spark, tmp_path):
    first, late = (ledger(spark, [(1, "Cash", p, f"{p}-{i}", None) for i in range(30)]) for p in ("early", "later"))
    index = X.build(first, str(tmp_path / "x"), block_rows=10)
    X.append(late.withColumn("row_id", F.concat(F.lit("n"), "row_id")), index, block_rows=10)
    assert index.search("cash").count() == 60 and index.search("later-2").count() == 11
    stray = first.withColumns({X.BATCH: F.lit("dead"), X.BLOCK: F.lit(0)})
    stray.write.mode("append").partitionBy(X.BATCH, X.BLOCK).parquet(f"{index.path}/rows")
    assert index.search("cash").count() == 60 and index.search("ca").count() == 60
    empty = X.build(first.limit(0), str(tmp_path / "y"))
    assert empty.search("cash").count() == 0 and empty.search("c").count() == 0
