"""Entity detection goes in stored steps, so that the small sides of its joins are not all in the driver at once."""

import pytest

from ledgerloom.operators import privacy as P


@pytest.mark.parametrize("operator", [P.detect_entities, P.tokenise_text])
def test_few_joins_are_planned_at_once(spark, monkeypatch, operator):
    texts = spark.createDataFrame([(1, "n1", "paid Acme Trading Co and Acme Tradng Co"), (1, "n2", None), (2, "n1", "Zenith Works")],
                                  "ledger_id int, note_id string, text string")
    terms = spark.createDataFrame([(1, "Acme Trading Co", "VENDOR"), (2, "Zenith Works", "CUSTOMER")], "ledger_id int, term string, category string")
    planned, kept = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: planned.append(df) or kept(df, name))
    planned.append(operator(texts, terms, ["ledger_id"], "note_id", "text"))
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in planned]
    assert len(joins) == 4 and max(joins) <= 9
    assert planned[-1].count() >= 2
