"""The physical plans are the ones we want at scale."""

import re

import pytest

import __spark_entry__ as entry
from ledgerloom.plans.registry import Data
from ledgerloom.sources import files

TEXT_HELPERS = {"detect_amounts", "detect_entities", "detect_entities_dictionary", "corpus_tokens", "tokenise_text", "detokenise_text"}
CHECKED = ["ap_aging", "overdue_debtors_30_60_90", "scan", "dup_pairs", "recon_run", "flux", "pl_questions", "fuzzy_party_join",
           "similar_questions", "vector_topk", "keyword_retrieval", "map_columns", "invoice_anti_both", "pulse_digest",
           "readiness_score", "gl_gstr1_006", "knowledge_autoresolve", "detect_entities", "detect_doc_type"]


@pytest.fixture(autouse=True)
def long_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_joins_and_no_row_udfs(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in TEXT_HELPERS:
        assert "ArrowEvalPython" not in text


def test_period_reaches_the_scan(spark, sf):
    d = Data(spark, sf)
    text = plan(entry.queries()["filter_period"](spark, sf))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(transaction_date", text)
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "description" not in read and "vendor_name" not in read
    assert d.gl.columns


def test_written_ledger_prunes_partitions(spark, sf, tmp_path):
    path = str(tmp_path / "gl")
    small = Data(spark, sf).gl_all.filter("ledger_id < 4 AND transaction_date >= '2001-03-01'")
    files.sink_gl(small, path)
    text = plan(files.scan_gl(spark, path, [1], "2001-04-01", "2001-06-30"))
    assert "PartitionFilters" in text and re.search(r"PartitionFilters: \[[^\]]*ledger_id", text) and "month" in text


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(entry.queries()["vector_topk"](spark, sf))
