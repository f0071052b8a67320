"""Every query with a reference SQL text returns the same rows as DuckDB."""

import decimal
import math

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import catalog

NAMES = sorted(entry.oracle_sql())


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    res = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want)


def test_queries_without_sql_are_few(spark):
    extra = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert extra == {"pattern_keys_agent", "detect_amounts", "detect_entities", "tokenise_text"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["ledger_id", "customer"] and df.count() > 0
