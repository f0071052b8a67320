"""Amounts, names, account codes and word runs of a text, as column expressions.

Every finder yields arrays in reading order and never leaves the JVM.  A missing or empty
text gives empty arrays.  Positions count characters from 0.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, functions as F

from .spans import ascii_edges, let, overlaps, spans

# fixed values: (format, currency, multiplier, pattern), most specific first
RS = r"(?:₹|Rs\.?\s*)"
AMOUNTS = [
    ("indian-crore-abbr", "INR", 1e7, r"(?i)" + RS + r"(\d+(?:\.\d+)?)\s*Cr\b"),
    ("indian-lakh-abbr", "INR", 1e5, r"(?i)" + RS + r"(\d+(?:\.\d+)?)\s*L\b"),
    ("indian-crore-spelled", "INR", 1e7, r"(?i)(\d+(?:\.\d+)?)\s*(?:crores?|karod)\b"),
    ("indian-lakh-spelled", "INR", 1e5, r"(?i)(\d+(?:\.\d+)?)\s*(?:lakhs?)\b"),
    ("us-abbr", "USD", 1.0, r"(?i)\$\s*(\d+(?:\.\d+)?)\s*([BMK])\b"),
    ("indian", "INR", 1.0, RS + r"(\d{1,2}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)"),
    ("us", "USD", 1.0, r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"),
    ("european", "EUR", 1.0, r"€\s*(\d{1,3}(?:\.\d{3})*(?:,\d+)?)"),
    ("uk", "GBP", 1.0, r"£\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"),
    ("code-suffix", "", 1.0, r"(?i)\b(\d[\d,.]*)\s+(USD|INR|EUR|GBP)\b"),
    ("plain-keyword", "INR", 1.0,
     r"(?i)\b(?:amount|balance|total|revenue|expense|cost|invoice|payment|over|under|above|below|exceeds|greater|less|"
     r"baaki|raashi)\s+(?:of\s+)?(\d{1,3}(?:,\d{3})+|\d{4,})(?:\.\d+)?\b"),
    ("plain-keyword", "INR", 1.0, r"(?i)\b(\d{1,3}(?:,\d{3})+|\d{4,})(?:\.\d+)?\s+(?:amount|balance|total|rupees?)\b"),
]
# fixed value: 4-digit codes, segmented codes, AC- / GL- prefixes
ACCOUNT = r"\b(?:(?:AC|GL)-)?(\d{4})(?:[-.](\d{2,3})(?:[-.](\d{2,3}))?)?\b"
UNITS = {"B": 1e9, "M": 1e6, "K": 1e3}
# fixed values: phrases that introduce a name
LABELLED = r"(?im)\b{word}\s*:\s*([A-Z][A-Za-z0-9\s&.,'-]{{2,50}}?)(?=[,;.\n]|$)"
LINKED = r"(?im)\b{word}\s+([A-Z][A-Za-z0-9\s&.'-]{{2,40}}?)(?=\s+(?:{stops})|[,;.\n]|$)"
CONTEXT = [
    ("VENDOR", LABELLED.format(word="vendor")), ("VENDOR", LABELLED.format(word="supplier")),
    ("CUSTOMER", LABELLED.format(word="customer")), ("CUSTOMER", LABELLED.format(word="client")),
    ("EMPLOYEE", LABELLED.format(word="employee")), ("ENTITY", LABELLED.format(word="company")),
    ("ENTITY", LINKED.format(word="from", stops="for|to|and|or|in|at|on|with|by")),
    ("ENTITY", LINKED.format(word="to", stops="for|from|and|or|in|at|on|with|by")),
    ("ENTITY", LINKED.format(word="for", stops="from|to|and|or|in|at|on|with|by")),
]
# fixed values: accounting words never taken for a name
NOT_NAMES = set("""
AP AR GL PL BS Revenue Expense Expenses Balance Trial Journal Ledger Ledgers Voucher Vouchers Invoice Invoices Receipt
Receipts Account Accounts Transaction Transactions Entry Entries Record Records Report Reports OPEX CAPEX EBITDA COGS
PnL P&L Budget Forecast Variance Variances Accrual Accruals Prepaid Depreciation Amortisation Amortization Cash Bank
Payable Receivable Inventory Assets Liabilities Equity Capital Debit Debits Credit Credits Show Get Find List Display
Calculate Total Sum Count Average Group India March April June July August September October November December January
February Monday Tuesday Wednesday Thursday Friday Q1 Q2 Q3 Q4 FY YTD MTD QTD
""".lower().split())

AMOUNT_ROWS = "array<struct<position:int,original:string,value:double,currency:string,format:string,start:int,stop:int>>"
NAME_ROWS = "array<struct<value:string,category:string,confidence:double,method:string,start:int>>"
TOKEN_ROWS = "array<struct<token:string,original:string>>"


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def _value(digits: Column) -> Column:
    """The number a text starts with, thousands commas dropped."""
    return F.regexp_extract(F.replace(digits, F.lit(","), F.lit("")), r"^\d+(?:\.\d+)?", 0).try_cast("double")


def _last_place(whole: Column, part: Column) -> Column:
    return F.length(whole) - F.length(part) + 1 - F.instr(F.reverse(whole), F.reverse(part))


def _amount_row(fmt: str, currency: str, factor: float, m: Column) -> Column:
    digits, unit = m["m1"], F.upper(m["m2"]) if fmt in ("us-abbr", "code-suffix") else None
    named, money, scale, at, shown = F.lit(fmt), F.lit(currency), F.lit(factor), m["start"], m["m0"]
    if fmt == "us-abbr":
        named = F.concat(F.lit("us-"), unit, F.lit("-abbr"))
        scale = F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)
    elif fmt == "code-suffix":
        money = unit
    elif fmt == "european":
        digits = F.translate(digits, ",.", ".")
    elif fmt == "plain-keyword":
        at, shown = at + _last_place(shown, digits), digits
    return F.struct(at.cast("int").alias("position"), shown.alias("original"), (_value(digits) * scale).alias("value"),
                    money.alias("currency"), named.alias("format"), m["start"].alias("start"), m["stop"].alias("stop"))


def find_amounts(text: Column) -> Column:
    """Amounts in reading order.  Where two patterns' matches touch, the one of the earlier pattern stands."""
    ranked = F.concat(*[
        F.transform(spans(text, ascii_edges(p), 2 if fmt in ("us-abbr", "code-suffix") else 1),
                    partial(_amount_row, fmt, currency, factor)).cast(AMOUNT_ROWS)
        for fmt, currency, factor, p in AMOUNTS])
    stands = F.aggregate(ranked, none_of(AMOUNT_ROWS), lambda kept, a: F.when(
        F.exists(kept, lambda k: overlaps(k, a)), kept).otherwise(F.concat(kept, F.array(a))))
    found = F.transform(F.array_sort(stands), lambda a: F.struct(*[a[c].alias(c) for c in (
        "position", "original", "value", "currency", "format")]))
    return F.when(text.rlike(r"\d"), found).otherwise(F.transform(none_of(AMOUNT_ROWS), lambda a: F.struct(*[
        a[c].alias(c) for c in ("position", "original", "value", "currency", "format")])))


def _name_row(category: str, m: Column) -> Column:
    value = F.regexp_replace(m["m1"], r"^\s+|\s+$", "")
    return F.struct(value.alias("value"), F.lit(category).alias("category"), F.lit(0.5).alias("confidence"), F.lit("context").alias("method"),
                    (m["start"] + F.instr(m["m0"], value) - 1).cast("int").alias("start"))


def _introduced(text: Column) -> Column:
    """Capitalised names behind a phrase; accounting words are none."""
    rows = F.concat(*[F.transform(spans(text, ascii_edges(p).replace("(?im)", "(?imd)"), 1), partial(_name_row, category)).cast(NAME_ROWS)
                      for category, p in CONTEXT])
    return F.filter(rows, lambda e: (F.length(e["value"]) >= 2) & e["value"].rlike("^[A-Z]") & ~F.lower(e["value"]).isin(sorted(NOT_NAMES)))


def merge_names(text: Column, known: Column) -> Column:
    """``known`` names and those a phrase introduces: best confidence per value, in reading order.

    An introduced name gives way to a known one that it equals (in any case) or touches.
    """
    def reach(e: Column) -> Column:
        return F.struct(e["start"].alias("start"), (e["start"] + F.length(e["value"])).alias("stop"))

    free = F.filter(_introduced(text), lambda e: ~F.exists(known, lambda k: (F.lower(k["value"]) == F.lower(e["value"])) | overlaps(reach(k), reach(e))))
    best_first = F.array_sort(F.transform(F.concat(F.array_sort(known), free), lambda e, i: F.struct(
        (-e["confidence"]).alias("rank"), e["start"].alias("start"), e["value"].alias("value"), i.alias("i"), e.alias("e"))))
    first = let(F.struct(best_first.alias("rows"), F.transform(best_first, lambda b: F.lower(b["value"])).alias("spelt")), lambda s: F.filter(
        s["rows"], lambda b, i: F.array_position(s["spelt"], F.lower(b["value"])) == i + 1))
    ordered = F.array_sort(F.transform(first, lambda b: F.struct(b["start"].alias("start"), b["value"].alias("value"), b["e"].alias("e"))))
    return F.transform(ordered, lambda b: b["e"]).cast(NAME_ROWS)


def _next_token(held: Column, category: Column) -> Column:
    n = F.size(F.filter(held, lambda t: t["token"].startswith(F.concat(category, F.lit("_T"))))) + 1
    return F.concat(category, F.lit("_T"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def _with_token(held: Column, category: Column, value: Column) -> Column:
    """The token table with a token for ``value``."""
    new = F.array(F.struct(_next_token(held, category).alias("token"), value.alias("original")))
    return F.when(F.exists(held, lambda t: t["original"] == value), held).otherwise(F.concat(held, new)).cast(TOKEN_ROWS)


def token_of(held: Column, value: Column) -> Column:
    return F.get(F.filter(held, lambda t: t["original"] == value), 0)["token"]


def _longest_first(rows: Column, value: str) -> Column:
    return F.transform(F.array_sort(F.transform(rows, lambda e, i: F.struct(
        (-F.length(e[value])).alias("n"), i.alias("i"), e.alias("e")))), lambda s: s["e"])


def name_tokens(text: Column, names: Column) -> Column:
    """struct(text, map): every name, longest first, stands as its token."""
    def put(state: Column, e: Column) -> Column:
        held = _with_token(state["map"], e["category"], e["value"])
        return F.struct(F.replace(state["text"], e["value"], token_of(held, e["value"])).alias("text"), held.alias("map"))

    return F.aggregate(_longest_first(names, "value"), F.struct(text.alias("text"), none_of(TOKEN_ROWS).alias("map")), put)


def amount_tokens(text: Column, held: Column, amounts: Column) -> Column:
    """struct(text, map): every amount that has no token yet, longest first."""
    def put(state: Column, a: Column) -> Column:
        grown = _with_token(state["map"], F.lit("AMOUNT"), a["original"])
        return F.when(F.exists(state["map"], lambda t: t["original"] == a["original"]), state).otherwise(F.struct(
            F.replace(state["text"], a["original"], token_of(grown, a["original"])).alias("text"), grown.alias("map")))

    return F.aggregate(_longest_first(amounts, "original"), F.struct(text.alias("text"), held.alias("map")), put)


def account_map(text: Column, held: Column) -> Column:
    """The token table with the account codes, numbered from the end of the text."""
    codes = F.reverse(F.regexp_extract_all(text, F.lit(ascii_edges(ACCOUNT)), F.lit(0)))
    return F.aggregate(codes, held, lambda acc, code: _with_token(acc, F.lit("ACCT"), code))


def account_text(text: Column, held: Column) -> Column:
    codes = F.regexp_extract_all(text, F.lit(ascii_edges(ACCOUNT)), F.lit(0))
    tokens = F.transform(codes, lambda c: token_of(held, c))
    return F.array_join(F.zip_with(F.split(text, ascii_edges(ACCOUNT), -1), tokens, lambda gap, t: F.concat(gap, F.coalesce(t, F.lit("")))), "")


def _runs(parts: Column, size: Column, join: str) -> Column:
    """Every ``size`` neighbours of an array, joined."""
    last = F.size(parts) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(parts, i + 1, size), join))).otherwise(
        none_of("array<string>"))


def pieces(text: Column) -> Column:
    """Distinct characters and three-letter pieces of a text."""
    return let(F.filter(F.split(text, ""), lambda c: c != ""), lambda chars: F.array_distinct(F.concat(chars, _runs(chars, F.lit(3), ""))))


def runs_of(text: Column, wanted: Column, sizes: list[int]) -> Column:
    """Distinct runs of as many characters as ``wanted`` holds, out of ``sizes``, each read in one pass over the text."""
    return F.array_distinct(F.concat(*[
        F.when(F.array_contains(wanted, n), F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).otherwise(none_of("array<string>"))
        for n in sizes]))


def windows(text: Column, size: Column) -> Column:
    """Runs of ``size`` words, one per starting word."""
    return let(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda words: _runs(words, size, " "))
