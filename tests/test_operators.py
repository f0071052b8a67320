"""Boundaries, brute-force comparisons and seeded faults on small fixtures."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import matching as M
from ledgerloom.functions.names import fuzzy_pairs
from ledgerloom.operators import accounts as A
from ledgerloom.operators import checks as C
from ledgerloom.operators import flux as X
from ledgerloom.operators import knowledge as K
from ledgerloom.operators import privacy as P
from ledgerloom.operators import pulse, readiness, retrieval, routing, schema_intel, tax_docs
from ledgerloom.sources import files
from ledgerloom.sources.schema import conform

D = dt.date
START, END = "2024-04-01", "2024-06-30"


def ledger(spark, rows):
    """rows: (ledger, ref, day, account, dr, cr[, party])"""
    full = [r if len(r) == 7 else (*r, None) for r in rows]
    df = spark.createDataFrame(
        [(r[0], f"r{i}", r[1], r[2], r[3], str(r[4]), str(r[5]), r[6]) for i, r in enumerate(full)],
        "ledger_id int, row_id string, reference_number string, transaction_date date, account_name string, "
        "dr string, cr string, party_name string")
    df = df.select("ledger_id", "row_id", "reference_number", "transaction_date", "account_name", "party_name",
                   F.col("dr").cast("decimal(20,4)").alias("debit_amount"), F.col("cr").cast("decimal(20,4)").alias("credit_amount"),
                   F.lit("Sales").alias("voucher_type"))
    return conform(df).withColumn("net_amount", (F.col("debit_amount") - F.col("credit_amount")).cast("decimal(20,4)"))


def one(spark, code, rows):
    got = C.check(code, ledger(spark, rows), START, END).collect()
    return got[0] if got else None


@pytest.mark.parametrize("gap, hit", [("0.99", False), ("1", True)])
def test_trial_balance_tolerance(spark, gap, hit):
    r = one(spark, "trial_balance_mismatch", [(1, "a", D(2024, 5, 1), "Bank", gap, 0)])
    assert (r is not None) == hit


@pytest.mark.parametrize("diff, hit", [("0.01", False), ("0.02", True)])
def test_voucher_imbalance_tolerance(spark, diff, hit):
    r = one(spark, "voucher_imbalance", [(1, "a", D(2024, 5, 1), "Bank", diff, 0)])
    assert (r is not None) == hit


def brute_pairs(rows):
    keep = [r for r in rows if max(r[4], r[5]) > 100 and r[1] is not None]
    out = []
    for a, b in itertools.permutations(keep, 2):
        same = a[0] == b[0] and a[6] == b[6] and max(a[4], a[5]) == max(b[4], b[5])
        if same and a[1] < b[1] and abs((a[2] - b[2]).days) <= 7:
            out.append((a[0], a[6], max(a[4], a[5]), a[1], a[2], b[1], b[2]))
    return out


def test_duplicates_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(160):
        hot = rng.random() < 0.5
        rows.append((rng.choice([1, 2]), f"v{rng.randrange(30):02d}", D(2024, 4, 1) + dt.timedelta(rng.randrange(60)), "Acct",
                     500 if hot else rng.choice([50, 100, 200, 300]), 0, "hot" if hot else rng.choice(["p", "q"])))
    gl = C.with_period(ledger(spark, rows), START, END)
    pairs = brute_pairs(rows)
    got = {r.ledger_id: (r.affected_rows, r.exposure) for r in C.run_checks(gl, ["duplicate_transactions"]).collect()}
    for lid in (1, 2):
        mine = [p for p in pairs if p[0] == lid]
        assert got[lid] == (len(mine), float(sum(p[2] for p in mine)))
    refs = {(r.ledger_id, r.reference_number) for r in C.duplicate_refs(gl).collect()}
    assert refs == {(p[0], p[3]) for p in pairs} | {(p[0], p[5]) for p in pairs}
    top = sorted(tuple(r)[:7] for r in C.dup_pairs(gl, 12).collect())
    want = []
    for lid in (1, 2):
        mine = sorted((p for p in pairs if p[0] == lid), key=lambda p: (-p[2], p[1], p[3], p[4], p[5], p[6]))
        want += [(p[0], p[1], float(p[2]), *p[3:]) for p in mine[:12]]
    assert top == sorted(want)


def test_fuzzy_pairs_against_brute_force(spark):
    rng = random.Random(3)
    words = ["acme", "traders", "steel", "india", "global", "sons", "metal", "Pvt", "Ltd", "co"]
    make = lambda n: [(rng.choice([1, 2]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for _ in range(n)]
    left, right = make(60), make(60)

    def toks(s):
        return {w for w in s.lower().split() if w not in ("pvt", "ltd")}

    want = set()
    for (a, x), (b, y) in itertools.product(left, right):
        tx, ty = toks(x), toks(y)
        if a == b and tx and ty and len(tx & ty) / max(len(tx), len(ty)) > 0.5:
            want.add((a, x, y))
    cols = "ledger_id int, name string"
    got = fuzzy_pairs(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), ["ledger_id"], "name")
    assert {(r.ledger_id, r.left_name, r.right_name) for r in got.collect()} == want


@pytest.mark.parametrize("name, kind", [
    ("Petty Cash", "CASH"), ("HDFC Bank A/c", "BANK"), ("TDS Payable", "TAX"), ("Sundry Creditors", "PAYABLE"),
    ("Stock Journal", "UNKNOWN"), ("Stock in Hand", "INVENTORY"), ("Other Income", "OTHER_INCOME"), ("Interest Income", "REVENUE"),
    ("Purchase - Steel", "COGS"), ("Office Rent", "EXPENSE"), ("Share Capital", "EQUITY"), ("Zzz", "UNKNOWN")])
def test_classify_by_name(spark, name, kind):
    df = spark.createDataFrame([(name,)], "n string").select(A.classify_by_name(F.col("n")).alias("t"))
    assert df.first().t == kind


def test_prior_period_and_materiality(spark):
    assert X.prior_period("2024-04-01", "2024-06-30") == ("2024-01-01", "2024-03-31")
    rows = [(1, "a", D(2024, 2, 1), "X", 500000, 0), (1, "b", D(2024, 5, 1), "X", 550000, 0), (1, "c", D(2024, 5, 1), "Y", 50000, 0),
            (1, "d", D(2024, 2, 1), "Z", 500001, 0), (1, "e", D(2024, 5, 1), "Z", 550000, 0)]
    got = {r.account_name: (r.is_material, r.is_new_activity) for r in X.flux(ledger(spark, rows), START, END).collect()}
    assert got == {"X": (True, False), "Y": (True, True), "Z": (False, False)}


def test_short_hash_matches_a_plain_loop(spark):
    def fnv(s):
        h = 0x811C9DC5
        data = s.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i:i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = digits[r] + out
        return out.rjust(8, "0")[:8]

    texts = ["", "a", "Why is salary up?", "किराया ₹5L", "emoji 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.short_hash(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == {t: fnv(t) for t in texts}


@pytest.mark.parametrize("text, found", [
    ("₹5L total 5000", [("₹5L", 500000.0), ("5000", 5000.0)]), ("Rs. 1,23,456.78", [("Rs. 1,23,456.78", 123456.78)]),
    ("10 crores and 2.5 lakh", [("10 crores", 1e8), ("2.5 lakh", 250000.0)]), ("$2.5M", [("$2.5M", 2500000.0)]),
    ("€1.234,56", [("€1.234,56", 1234.56)]), ("12,500 USD", [("12,500 USD", 12500.0)]), ("total 5000 INR", [("5000 INR", 5000.0)]),
    ("in 2024", [])])
def test_amounts(spark, text, found):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = sorted((r.position, r.original_text, r.numeric_value) for r in P.detect_amounts(df, "k", "t").collect())
    assert [(o, pytest.approx(v)) for _, o, v in got] == found


def test_strip_pii_and_tokens_round_trip(spark):
    text = "Pay Acme Corp ₹5L, PAN ABCDE1234F, code 4000-100; vendor: Gupta & Sons"
    df = spark.createDataFrame([(1, 1, text)], "ledger_id int, k int, t string")
    terms = spark.createDataFrame([(1, "Acme Corp", "VENDOR"), (1, "Acme", "VENDOR")], "ledger_id int, term string, category string")
    out = P.tokenise_text(df, terms, ["ledger_id"], "k", "t", custom_strip=["Pay"])
    row = P.detokenise_text(out, "tokenised", "token_map", "back").first()
    assert "ABCDE1234F" not in row.tokenised and row.pii_stripped == 1
    assert "VENDOR_T001" in row.tokenised and "AMOUNT_T001" in row.tokenised and "ACCT_T001" in row.tokenised
    assert row.back.strip() == "Acme Corp ₹5L, PAN , code 4000-100; vendor: Gupta & Sons"


def test_dictionary_matching_against_brute_force(spark):
    rng = random.Random(5)
    terms = ["Acme Corp", "Sharma Traders", "Mehta", "xy", "Globex Steel"]
    texts = []
    for i in range(40):
        parts = [rng.choice(["pay", "for", "March", "to", "acme corp", "Sharma Tradrs", "MEHTA", "Globx Steel", "galaxy"]) for _ in range(6)]
        texts.append((1, i, " ".join(parts)))
    tdf = spark.createDataFrame(texts, "ledger_id int, k int, t string")
    ddf = spark.createDataFrame([(1, t, "VENDOR") for t in terms], "ledger_id int, term string, category string")
    exact = P.dictionary_exact(tdf, ddf, ["ledger_id"], "k", "t")
    want = {(k, t, s.lower().index(t.lower())) for _, k, s in texts for t in terms if t.lower() in s.lower()}
    assert {(r.k, r.term, r.start) for r in exact.collect()} == want

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    near = set()
    for _, k, s in texts:
        words = s.split()
        for t in terms:
            if len(t) <= 5 or t.lower() in s.lower():
                continue
            n = len(t.split())
            for i in range(len(words) - n + 1):
                w = " ".join(words[i:i + n])
                if 1 <= lev(t.lower(), w.lower()) <= 2:
                    near.add((k, t, w))
                    break
    got = P.dictionary_fuzzy(tdf, ddf, exact, ["ledger_id"], "k", "t")
    assert {(r.k, r.term, r.value) for r in got.collect()} == near and near


def test_hinglish_leaves_names_alone(spark):
    df = spark.createDataFrame([("Jama ka baaki kitna",)], "t string")
    assert df.select(P.normalise_hinglish(F.col("t")).alias("x")).first().x == "Jama ka outstanding how much"


@pytest.mark.parametrize("question, report", [
    ("cash kitna hai", "cash_balance"), ("baaki customers dikhao", "overdue_debtors_30_60_90"), ("kar vivaran", "gst_summary"),
    ("vikreta khata dikhao", "vendor_ledger"), ("tankhwah kitni gayi", "payroll_summary"), ("munaafa kitna hua", "profit_loss_summary"),
    ("kar katautee", "tds_summary"), ("sabse bade grahak", "top_customers"), ("pichli timahi bikri dikhao", "sales_last_quarter"),
    ("karya poonji", "working_capital"), ("baaki bill dikhao", "pending_bills"), ("khata wise mahine ka vivaran", "account_monthly_drill"),
    ("mahine ke ant ki summary", "period_close_summary"), ("what is the weather today", None), ("", None)])
def test_routing(spark, question, report):
    df = spark.createDataFrame([(question,)], "q string")
    assert routing.route_questions(df, "q").first().report == report


@pytest.mark.parametrize("raw, number, day", [
    ("₹1,234.50", 1234.5, None), ("abc", None, None), ("$ 7", 7.0, None), ("3/4/24", 3.0, D(2024, 4, 3)), ("2024-05-06", 2024.0, D(2024, 5, 6))])
def test_value_parsing(spark, raw, number, day):
    r = spark.createDataFrame([(raw,)], "v string").select(
        files.parse_number(F.col("v")).cast("double").alias("n"), files.parse_day(F.col("v")).alias("d")).first()
    assert (r.n, r.d) == (number, day)


def test_delimiter():
    assert files.pick_delimiter("a;b;c\n1;2;3") == ";" and files.pick_delimiter("abc") == ","


def test_readiness_gate_blocks(spark):
    facts = spark.createDataFrame([(1, True, 0, 0, 0, 0, 0, 0, 0, 0.0, 4, 0, 4, 0, 0, 5, 5), (2, True, 0, 0, 0, 21, 0, 0, 0, 0.0, 4, 0, 4, 0, 0, 5, 5)],
        "ledger_id int, scanned boolean, critical int, review int, date_outliers int, missing_fields int, gst_mismatch int, "
        "sign_anomalies int, duplicate_transactions int, imbalance double, passed int, failed int, recons int, material_count int, "
        "explained int, completed int, total int")
    got = {r.ledger_id: (r.score, r.status) for r in readiness.readiness_score(facts).collect()}
    assert got == {1: (100, "ready"), 2: (98, "blocked")}


def test_compliance_calendar():
    names = lambda d: [c[0] for c in pulse.calendar(d)]
    assert names("2024-06-08") == ["tds_deadline", "gstr1_deadline", "advance_tax"]
    assert names("2024-06-25") == []
    assert names("2025-03-17") == ["advance_tax"]


def test_text_similarity(spark):
    df = spark.createDataFrame([("show vendor aging report", "vendor aging summary"), ("the of", "vendor")], "a string, b string")
    got = [round(r.s, 6) for r in df.select(retrieval.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [round(2 / 4 + 0.1, 6), 0.0]


def test_header_mapping(spark):
    rows = [(1, i, h) for i, h in enumerate(["Vch Dat", "दिनांक", "Dr. Amount", "Naration", "Qqq"])]
    df = schema_intel.map_columns(spark.createDataFrame(rows, "file_id int, position int, header string"),
                                  schema_intel.ref_column_aliases(spark))
    got = {r.header: (r.canonical, r.method) for r in df.collect()}
    assert got["दिनांक"] == ("transaction_date", "exact") and got["Dr. Amount"] == ("debit_amount", "exact")
    assert got["Naration"] == ("description", "fuzzy") and got["Qqq"] == (None, "unmapped")


def test_dates_in_returns(spark):
    r = spark.createDataFrame([("31/12/2023", "2024-01-05T10:00:00", "x")], "a string, b string, c string").select(
        *[tax_docs.day(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(r) == (D(2023, 12, 31), D(2024, 1, 5), None)


def test_ascii_edges_ignore_accents():
    import re
    assert re.search(M.ascii_edges(r"\b1234\b"), "é1234", re.ASCII)


def test_party_column_is_chosen_per_ledger(spark):
    from ledgerloom.operators.reports import report

    gl = ledger(spark, [
        (1, "a", D(2024, 5, 1), "Sundry Debtors", 100, 0, "Acme"), (1, "a", D(2024, 5, 1), "Sales", 0, 100),
        (2, "b", D(2024, 5, 1), "Sundry Debtors", 70, 0)])
    got = {(r.ledger_id, r.customer) for r in report("customer_ledger", gl, "2024-06-30").collect()}
    assert got == {(1, "Acme"), (2, "Sundry Debtors")}
    aged = {(r.ledger_id, r.customer): r.total_outstanding for r in report("overdue_debtors_30_60_90", gl, "2024-06-30").collect()}
    assert aged == {(1, "Acme"): 100.0, (2, "Sundry Debtors"): 70.0}


def test_tds_summary_takes_the_filled_side(spark):
    from ledgerloom.operators.reports import report

    gl = ledger(spark, [(1, "a", D(2024, 5, 1), "TDS Payable", 0, 25, "Acme"), (1, "b", D(2024, 5, 2), "TDS Payable", 5, 0, "Acme")])
    assert [r.tds_amount for r in report("tds_summary", gl, "2024-06-30").collect()] == [30.0]


def test_pages_of_the_query_log_are_the_whole_log(spark):
    log = spark.createDataFrame([(i, 1, "COMPLETED", D(2024, 1, 1 + (i * 7) % 5)) for i in range(23)],
                                "query_id long, ledger_id int, status string, created_at date")
    seen, cursor = [], None
    while page := retrieval.query_log_page(log, 4, cursor=cursor).collect():
        seen += [(r.created_at, r.query_id) for r in page]
        cursor = (str(page[-1].created_at), page[-1].query_id)
    assert seen == sorted(((r.created_at, r.query_id) for r in log.collect()), reverse=True)


def test_long_names_keep_their_own_keys(spark):
    names = ["Account " * 12 + tail for tail in ("north", "south")]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(K.manual_key(F.col("n")).alias("k")).collect()
    assert len({r.k for r in rows}) == 2


def test_edits_at_one_instant_are_decided(spark):
    gl = ledger(spark, [(1, "V1", D(2024, 4, 2), "Rent", 10, 0), (1, "V1", D(2024, 4, 2), "Bank", 0, 10)])
    edits = spark.createDataFrame([(1, "r0", "description", "b", 5), (1, "r0", "description", "a", 5), (1, "r0", "description", "z", 4)],
                                  "ledger_id int, row_id string, field string, value string, edited_at int")
    for order in (edits.orderBy("value"), edits.orderBy(F.desc("value"))):
        got = {r.row_id: r.description for r in schema_intel.apply_corrections(gl, order).collect()}
        assert got["r0"] == "b"
    toggles = spark.createDataFrame([(1, "r1", False, 5), (1, "r1", True, 5), (1, "r0", True, 4), (1, "r0", False, 5)],
                                    "ledger_id int, row_id string, exclude boolean, edited_at int")
    got = {r.row_id: r.excluded for r in schema_intel.apply_exclusions(gl, toggles).collect()}
    assert got == {"r0": False, "r1": True}


def test_numbers_with_an_exponent(spark):
    df = spark.createDataFrame([("1.2e3",), ("₹ 1,500.50",), ("7 e",), ("x",)], "s string")
    assert [None if r.n is None else float(r.n) for r in df.select(files.parse_number(F.col("s")).alias("n")).collect()] == [1200.0, 1500.5, 7.0, None]


def test_mask_audit_refuses_no_rows(spark):
    log = spark.createDataFrame([], "ledger_id int, call_id int, model string, masked_json string, created_at date")
    with pytest.raises(ValueError):
        P.mask_audit(log, 0)


def test_last_deposit_goes_by_number(spark):
    rows = [(1, f"{k}-{line}", "0001234", D(2024, 5, 7), "11", 10.0, 100.0 * k + line) for k in (9, 10) for line in (2, 11, 1)]
    df = spark.createDataFrame(rows, "ledger_id int, row_key string, bsr_code string, challan_date date, challan_serial_no string, tds_deducted double, tds_deposited double")
    assert [r.deposited for r in tax_docs.deposit_gaps(df.repartition(3)).collect()] == [1011.0]
