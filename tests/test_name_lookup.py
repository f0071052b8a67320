"""Names are looked up by pieces that few of them share, and no table that grows goes through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import privacy as P

TERMS = "ledger_id int, term string, category string"
TEXTS = "ledger_id int, k int, t string"


def test_exact_names_of_any_length_against_brute_force(spark):
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abÉ😀 -") for _ in range(n)).strip() or "a" for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 50) for _ in range(4)})
    texts = [(i % 2, i, "".join(rng.choice(["a", "B", "é", "\n", *terms]) for _ in range(6))) for i in range(60)] + [(1, 60, None), (0, 61, "")]
    table = spark.createDataFrame([(0, t, "A") for t in terms] + [(1, t, "B") for t in terms[::2]], TERMS)
    got = [(r.k, r.term, r.start) for r in P.dictionary_exact(spark.createDataFrame(texts, TEXTS), table, ["ledger_id"], "k", "t").collect()]
    want = {(k, t, s.lower().index(t.lower())) for n, k, s in texts for t in (terms, terms[::2])[n] if s and t.lower() in s.lower()}
    assert set(got) == want and len(got) == len(want)


def test_numbered_names_do_not_share_pieces(spark):
    names = [f"Customer#{i:09d}" for i in range(4000)]
    table = spark.createDataFrame([(1, n, "A") for n in names], TERMS)
    shared = P.anchors(table, ["ledger_id"]).groupBy("gram").count().agg(F.max("count")).first()[0]
    assert shared <= 10  # the rarest three letters are those of hundreds


@pytest.mark.parametrize("operator", [P.detect_entities, P.tokenise_text])
def test_only_tables_of_bounded_size_are_broadcast(spark, monkeypatch, operator):
    texts = spark.createDataFrame([(1, 1, "paid Acme Trading Co and Acme Tradng Co"), (2, 2, "Zenith Works")], TEXTS)
    table = spark.createDataFrame([(1, "Acme Trading Co", "VENDOR"), (2, "Zenith Works", "CUSTOMER")], TERMS)
    planned, kept = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: planned.append(df) or kept(df, name))
    planned.append(operator(texts, table, ["ledger_id"], "k", "t"))
    found = [df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") for df in planned]
    # sizes and filter of the pieces; lengths of the windows, for each of the keys, twice or thrice; none at the end
    assert max(found) <= 4 and found[-1] == 0
