"""Name index and token rules of text privacy against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import matching as M
from ledgerloom.operators import privacy as P

TERMS = "ledger_id int, words int, low string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + s[i + 1:], s[:i] + "q" + s[i:], s[:i] + "z" + s[i + 1:]])
    return s


def test_near_terms_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words += ["".join(rng.choice("ab") for _ in range(n)) for n in (47, 48, 49, 50, 51, 120)]
    asked = sorted({edited(rng, w, rng.randint(0, 3)) for w in words for _ in range(3)} | {"abc", ""})
    terms = spark.createDataFrame([(1, 1, w) for w in words] + [(2, 1, words[0])], TERMS).distinct()
    windows = spark.createDataFrame([(1, 1, w) for w in asked], "ledger_id int, words int, window string")
    got = {(r.window, r.low) for r in P.near_terms(windows, terms, ["ledger_id"]).collect()}
    assert got == {(a, w) for a in asked for w in words if 1 <= distance(a, w) <= 2}
    assert P.near_terms(windows.limit(0), terms, ["ledger_id"]).count() == 0


def test_names_with_one_prefix_bring_few_candidates(spark):
    rng = random.Random(4)
    names = sorted({"customer account " + "".join(rng.choice("0123456789") for _ in range(9)) for _ in range(4000)})
    asked = sorted({edited(rng, n, 2) for n in names[::4]})
    terms = spark.createDataFrame([(1, 3, n) for n in names], TERMS)
    windows = spark.createDataFrame([(1, 3, w) for w in asked], "ledger_id int, words int, window string")
    candidates = P.near_terms(windows, terms, ["ledger_id"], verify=False).count()
    got = P.near_terms(windows, terms, ["ledger_id"]).count()
    assert got >= 0.95 * len(asked) and candidates <= 5 * len(asked)


def test_windows_and_pieces(spark):
    texts = ["", "one", "a bc  d\te", "éa😀b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", M.windows(F.col("t"), F.lit(2)).alias("w"), M.pieces(F.col("t")).alias("p")).collect():
        words = (r.t or "").split()
        assert (r.w or []) == [" ".join(words[i:i + 2]) for i in range(len(words) - 1)]
        assert set(r.p or []) == set(r.t or "") | {r.t[i:i + 3] for i in range(len(r.t or "") - 2)}


@pytest.mark.parametrize("text, want", [
    (None, []), ("", []), ("vendor: Acme Corp, due", [("Acme Corp", 8)]), ("paid to Mehta for March", [("Mehta", 8)]),
    ("from Cash to Bank", []), ("client: Zed; client: ZED", [("Zed", 8)]), ("from lower case", [])])
def test_introduced_names(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(M.merge_names(F.coalesce("t", F.lit("")), F.array().cast(M.NAME_ROWS)).alias("n"))
    assert [(e.value, e.start) for e in df.first().n] == want


def test_known_names_win_over_introduced_ones(spark):
    known = [("Acme", "VENDOR", 1.0, "dictionary", 5), ("Acme", "VENDOR", 0.8, "dictionary", 5)]
    df = spark.createDataFrame([("from Acme Corp, to Zed", known)], f"t string, known {M.NAME_ROWS}")
    names = df.select(M.merge_names(F.col("t"), F.col("known")).alias("n")).first().n
    assert [(e.value, e.confidence, e.method) for e in names] == [("Acme", 1.0, "dictionary"), ("Zed", 0.5, "context")]


def test_tokens_are_numbered_and_restored(spark):
    text = "Pay Acme and Acme Corp 12,500 USD then ₹5L, codes 4000-100 and 5100, again 5100"
    names = [("Acme", "VENDOR", 1.0, "dictionary", 4), ("Acme Corp", "VENDOR", 1.0, "dictionary", 13)]
    df = spark.createDataFrame([(1, 1, text)], "ledger_id int, k int, t string")
    terms = spark.createDataFrame([(1, n[0], n[1]) for n in names], "ledger_id int, term string, category string")
    row = P.detokenise_text(P.tokenise_text(df, terms, ["ledger_id"], "k", "t"), "tokenised", "token_map", "back").first()
    assert row.tokenised == "Pay VENDOR_T002 and VENDOR_T001 AMOUNT_T001 then AMOUNT_T002, codes ACCT_T002 and ACCT_T001, again ACCT_T001"
    assert row.back == text and len(row.token_map) == 6


def test_a_text_with_many_amounts_is_read_in_order(spark):
    text = " ".join(f"₹{i},000 and ${i}.5M" for i in range(10, 99)) + " word" * 5000
    got = P.detect_amounts(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("position").collect()
    want = [m.span() for m in re.finditer(r"₹\d\d,000|\$\d\d\.5M", text)]
    assert [(r.position, r.position + len(r.original_text)) for r in got] == want


def test_text_privacy_runs_without_python_workers(spark, sf):
    import __spark_entry__ as entry

    for name in ("detect_amounts", "detect_entities", "tokenise_text"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
