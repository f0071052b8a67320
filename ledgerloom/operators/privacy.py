"""Text privacy over columns: PII stripping, entity / amount / account detection, tokenisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import top_per
from ..functions.matching import (ACCOUNT, NAME_ROWS, account_map, account_text, amount_tokens, find_amounts, merge_names, name_tokens,
                                  runs_of, windows)
from ..functions.spans import WORD_EDGE, ascii_edges
from ..sources import staging
from ..sources.staging import stored

# --- PII ---------------------------------------------------------------------------

# fixed values: patterns in order; a GSTIN holds a PAN, so it goes first
PII = [
    ("GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]\b"),
    ("PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("AADHAAR", r"\b\d{4}\s\d{4}\s\d{4}\b|\b\d{12}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("EIN", r"\b\d{2}-\d{7}\b"),
    ("BANK_ACCOUNT", r"(?i)\baccount\b[\w\s#:]{0,30}?\b(\d{8,16})\b|\*{2,}\d{4,}"),
    ("PHONE", r"(?:\+91[-\s]?\d{10}|\(\d{3}\)\s?\d{3}-\d{4}|\b[6-9]\d{9}\b)"),
    ("EMAIL", r"(?i)\b(?:email|e-mail|mail|contact|employee|emp|hr|staff)\b[:\s]+[\w.+-]+@[\w.-]+\.[a-z]{2,}"),
]


def strip_pii(text: Column) -> Column:
    """Remove every PII item for good, then collapse runs of space."""
    for _, pattern in PII:
        text = F.regexp_replace(text, ascii_edges(pattern), "")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def pii_total(text: Column) -> Column:
    """How many items ``strip_pii`` removes."""
    n = F.lit(0)
    for _, pattern in PII:
        n = n + F.regexp_count(text, F.lit(ascii_edges(pattern)))
        text = F.regexp_replace(text, ascii_edges(pattern), "")
    return n


def count_pii(df: DataFrame, text: str) -> DataFrame:
    """Add one count per PII type, each taken after the earlier types are gone."""
    working = F.col(text)
    out = []
    for kind, pattern in PII:
        out.append(F.regexp_count(working, F.lit(ascii_edges(pattern))).alias(kind.lower()))
        working = F.regexp_replace(working, ascii_edges(pattern), "")
    return df.select("*", *out)


# --- amounts -----------------------------------------------------------------------


def with_amounts(df: DataFrame, text: str, out: str = "amounts") -> DataFrame:
    """Add the detected amounts of each text in reading order."""
    return df.withColumn(out, find_amounts(F.col(text)))


def detect_amounts(df: DataFrame, key: str, text: str) -> DataFrame:
    return with_amounts(df.select(key, text), text).select(key, F.inline_outer("amounts")).filter("original IS NOT NULL").withColumnsRenamed(
        {"original": "original_text", "value": "numeric_value"})


# --- accounts ----------------------------------------------------------------------

def detect_accounts(text: Column, pattern: str | None = None) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern or ascii_edges(ACCOUNT)), F.lit(0))


# --- entities ----------------------------------------------------------------------

FUZZY_MIN, MAX_EDITS = 5, 2
#: Lengths of the pieces that terms are looked up by.
SIZES = [1, 2, 4, 8, 16]
#: Words of 64 bits in the filter that a text's pieces pass: 2 MB, whatever the dictionary; one of some millions of terms lets more pass.
FILTER_WORDS = 1 << 18
#: Terms up to this length meet by what is left without two of their characters (at most 1,177 strings a term), longer ones by segment.
VARIANT_MAX = 48
ENTITY = ["value", "category", "confidence", "method", "start"]


def _anchor_size(low: Column) -> Column:
    """The longest of ``SIZES`` that a term holds: more than half of it, up to 31 characters."""
    size = F.lit(SIZES[0])
    for n in SIZES[1:]:
        size = F.when(F.length(low) >= n, F.lit(n)).otherwise(size)
    return size


def _marks(keys: list[str], gram: str) -> tuple[Column, Column]:
    """Word and bits of a piece in the filter of ``_filter_bits``: two bits of one of FILTER_WORDS words."""
    code = F.xxhash64(*keys, gram)
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(code, n).bitwiseAND(63).cast("int")) for n in (40, 48)]
    return F.pmod(code, F.lit(FILTER_WORDS)), bits[0].bitwiseOR(bits[1])


def _filter_bits(pieces_: DataFrame, keys: list[str]) -> DataFrame:
    """(word, bits): which pieces there may be.  At most FILTER_WORDS rows, however many pieces."""
    word, bits = _marks(keys, "gram")
    return pieces_.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def anchors(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., term, category, low, size, gram): the piece each term is looked up by."""
    t = terms.filter(F.trim("term") != "").select(*keys, "term", "category").distinct().withColumn("low", F.lower("term"))
    t = t.withColumn("size", _anchor_size(F.col("low")))
    cut = t.withColumn("gram", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("low") - F.col("size") + 1), lambda i: F.substring("low", i, F.col("size")))))
    counts = cut.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    return cut.join(counts.hint("merge"), [*keys, "gram"]).groupBy(*keys, "term", "category", "low", "size").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def dictionary_exact(texts: DataFrame, terms: DataFrame, keys: list[str], key: str, text: str) -> DataFrame:
    """Terms found anywhere in a text, case-insensitively.

    Each term is looked up by its rarest piece (rarest among the terms) of the longest size it holds, so names that share
    words, or a number's digits, do not bring each other's texts along; every hit is verified.  The pieces of
    a text pass a filter of bounded size before they travel.  ``terms``: (keys..., term, category).
    """
    anchor = anchors(terms, keys)
    # a row for each of the keys: which sizes its terms have
    sizes = anchor.groupBy(*keys).agg(F.collect_set("size").alias("sizes"))
    read = texts.select(*keys, key, F.lower(F.col(text)).alias("low_text")).join(F.broadcast(sizes), keys)
    grams = read.select(*keys, key, F.explode(runs_of(F.col("low_text"), F.col("sizes"), SIZES)).alias("gram"))
    word, bits = _marks(keys, "gram")
    grams = grams.withColumns({"word": word, "own": bits}).join(F.broadcast(_filter_bits(anchor, keys)), "word").filter(
        F.col("bits").bitwiseAND(F.col("own")) == F.col("own"))
    # only the keys and pieces travel; the text itself joins back for the few candidates
    cand = grams.select(*keys, key, "gram").join(anchor.hint("merge"), [*keys, "gram"]).select(*keys, key, "term", "category", "low")
    hit = cand.hint("merge").join(texts.select(*keys, key, text), [*keys, key]).withColumn("start", F.instr(F.lower(F.col(text)), F.col("low")) - 1)
    return hit.filter("start >= 0").select(*keys, key, "term", F.col("term").alias("value"), "category",
                                           F.lit(1.0).alias("confidence"), F.lit("dictionary").alias("method"), "start")


def shortened(low: Column) -> Column:
    """Hashes of a string and of all that is left of it when one or two characters go.

    Strings at most two edits apart share at least one, wherever they differ.
    """
    n = F.length(low)

    def without(s: Column, i: Column) -> Column:
        return F.concat(F.substring(s, F.lit(1), i), F.substring(s, i + 2, n))

    one = F.transform(F.sequence(F.lit(0), n - 1), lambda i: without(low, i))
    two = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(
        F.sequence(i, n - 2), lambda j: without(without(low, i), j))))
    return F.array_distinct(F.transform(F.concat(F.array(low), one, two), lambda s: F.xxhash64(s)))


def _segments(terms: DataFrame, keys: list[str]) -> DataFrame:
    cut = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring(
        "low", _third(i) + 1, _third(i + 1) - _third(i)).alias("piece")) for i in range(3)]))
    return terms.withColumn("s", cut).select(*keys, "words", "len", "low", "s.i", "s.piece")


def _third(i: int) -> Column:
    """Segment i of a term of length ``len`` starts here."""
    return F.floor(F.col("len") * i / 3).cast("int")


def near_terms(windows_: DataFrame, terms: DataFrame, keys: list[str], verify: bool = True) -> DataFrame:
    """(keys..., words, window, low) of distinct windows and terms one or two edits apart.

    ``windows_``: distinct (keys..., words, window); ``terms``: distinct (keys..., words, low); both in lower case.
    A window goes on only if it holds one of three segments of some term at most two places off, which ends
    nearly all prose.  It then meets terms by ``shortened`` strings, whole ones, so that a common
    prefix brings nothing together; only terms of more than VARIANT_MAX characters, whose
    segments are long, meet by segment.  ``verify=False`` returns the candidates.
    """
    terms = terms.withColumn("len", F.length("low"))
    segments = _segments(terms, keys)
    probes = windows_.withColumn("len", F.explode(F.sequence(F.length("window") - MAX_EDITS, F.length("window") + MAX_EDITS)))
    # a row for each of the keys, number of words and length
    probes = probes.join(F.broadcast(terms.select(*keys, "words", "len").distinct()), [*keys, "words", "len"])
    tries = [F.struct(F.lit(i).alias("i"), F.substring("window", F.greatest(_third(i) + 1 + d, F.lit(1)), _third(i + 1) - _third(i)).alias("piece"))
             for i in range(3) for d in range(-MAX_EDITS, MAX_EDITS + 1)]
    probes = probes.withColumn("s", F.explode(F.array_distinct(F.array(*tries)))).select(*keys, "words", "len", "window", "s.i", "s.piece")
    on = [*keys, "words", "len", "i", "piece"]
    long_ones = probes.filter(F.col("len") > VARIANT_MAX).join(segments.hint("merge"), on).select(*keys, "words", "window", "low")
    held = probes.filter(F.col("len") <= VARIANT_MAX).join(segments.select(*on).distinct().hint("merge"), on, "left_semi")
    codes = held.select(*keys, "words", "window").distinct().withColumn("code", F.explode(shortened(F.col("window"))))
    known = terms.filter(F.col("len") <= VARIANT_MAX).withColumn("code", F.explode(shortened(F.col("low")))).drop("len")
    pairs = codes.hint("merge").join(known, [*keys, "words", "code"]).select(*keys, "words", "window", "low").unionByName(long_ones)
    if verify:
        pairs = pairs.filter(F.levenshtein("low", "window", MAX_EDITS).between(1, MAX_EDITS))
    return pairs.distinct()


def dictionary_fuzzy(texts: DataFrame, terms: DataFrame, exact: DataFrame, keys: list[str], key: str, text: str) -> DataFrame:
    """Word windows one or two edits away from a longer term that the text does not hold exactly.

    Windows and terms are compared once each, however many texts hold them (``near_terms``); the first window
    of a text wins.
    """
    t = terms.filter(F.length("term") > FUZZY_MIN).select(*keys, "term", "category").distinct()
    t = t.withColumn("low", F.lower("term")).withColumn("words", F.size(F.split("term", r"\s+")))
    # a row for each of the keys and number of words
    asked = t.groupBy(*keys, "words").agg(F.collect_set(F.length("low")).alias("lens"))
    wins = texts.select(*keys, key, text).join(F.broadcast(asked), keys).select(
        *keys, key, "words", "lens", F.posexplode(windows(F.col(text), F.col("words"))).alias("at", "value"))
    wins = wins.withColumn("window", F.lower("value")).filter(F.arrays_overlap("lens", F.array(*[
        F.length("window") + d for d in range(-MAX_EDITS, MAX_EDITS + 1)]))).drop("lens")
    pairs = stored(near_terms(wins.select(*keys, "words", "window").distinct(), t.select(*keys, "words", "low").distinct(), keys), "near-terms")
    # pairs and terms grow with the dictionary: no side goes through the driver
    near = wins.join(pairs.hint("merge"), [*keys, "words", "window"]).join(t.hint("merge"), [*keys, "words", "low"])
    near = near.join(exact.select(*keys, key, "term").hint("merge"), [*keys, key, "term"], "left_anti")
    first = near.groupBy(*keys, key, "term", "category").agg(F.min_by("value", "at").alias("value"))
    pos = first.hint("merge").join(texts.select(*keys, key, text), [*keys, key]).withColumn(
        "start", F.instr(F.lower(F.col(text)), F.lower("value")) - 1)
    return pos.filter("start >= 0").select(*keys, key, "term", "value", "category", F.lit(0.8).alias("confidence"),
                                           F.lit("dictionary").alias("method"), "start")


def with_entities(texts: DataFrame, terms: DataFrame, keys: list[str], key: str, text: str) -> DataFrame:
    """Add ``entities``: dictionary and context names, best confidence per value, in reading order.

    Exact and near hits are stored as they are found: each is worked out once, and the driver holds the small sides of
    one step's joins at a time, not of all.
    """
    exact = stored(dictionary_exact(texts, terms, keys, key, text), "exact-names")
    fuzzy = stored(dictionary_fuzzy(texts, terms, exact, keys, key, text), "near-names")
    # a text holds a bounded number of names, so the list is as long as the text at most
    found = exact.unionByName(fuzzy).groupBy(*keys, key).agg(F.collect_list(F.struct(
        "value", "category", "confidence", "method", F.col("start").cast("int").alias("start"))).alias("found"))
    df = texts.join(found.hint("merge"), [*keys, key], "left")
    df = df.withColumn("found", F.coalesce("found", F.array().cast(NAME_ROWS)).cast(NAME_ROWS))
    return df.withColumn("entities", merge_names(F.col(text), F.col("found"))).drop("found")


def detect_entities(texts: DataFrame, terms: DataFrame, keys: list[str], key: str, text: str) -> DataFrame:
    # an inner generator would test the list for emptiness first, and so compute it twice
    return with_entities(texts, terms, keys, key, text).select(*keys, key, F.inline_outer("entities")).filter("value IS NOT NULL")


# --- tokens ------------------------------------------------------------------------

TOKEN_MAP = "array<struct<token:string,original:string>>"


def tokenise_text(texts: DataFrame, terms: DataFrame, keys: list[str], key: str, text: str,
                  custom_entities: list[str] | None = None, custom_strip: list[str] | None = None) -> DataFrame:
    """PII out, then entities, amounts, account codes and custom names become tokens.

    Returns (keys..., key, tokenised, token_map, pii_stripped).
    """
    clean = texts.select(*keys, key, strip_pii(F.col(text)).alias("clean"),
                         pii_total(F.col(text)).alias("pii_stripped"))
    # five steps read it, and stripping costs more than all of them
    clean = staging.stored(clean, "clean-texts")
    df = with_entities(clean, terms, keys, key, "clean")
    df = df.withColumn("_t", name_tokens(F.coalesce("clean", F.lit("")), F.col("entities")))
    df = df.withColumn("_a", find_amounts(F.col("_t.text")))
    df = df.withColumn("_t", amount_tokens(F.col("_t.text"), F.col("_t.map"), F.col("_a")))
    df = df.withColumn("_map", account_map(F.col("_t.text"), F.col("_t.map")))
    df = df.withColumn("_w", account_text(F.col("_t.text"), F.col("_map")))
    entity_count = F.size(F.filter("_map", lambda t: t["token"].startswith("ENTITY_")))
    extra = F.array().cast(TOKEN_MAP)
    for n, name in enumerate([c.strip() for c in custom_entities or [] if c.strip()]):
        token = F.concat(F.lit("ENTITY_T"), F.lpad((entity_count + n + 1).cast("string"), 3, "0"))
        df = df.withColumn("_w", F.replace(F.col("_w"), F.lit(name), token))
        extra = F.concat(extra, F.array(F.struct(token.alias("token"), F.lit(name).alias("original"))))
    for term in [c.strip() for c in custom_strip or [] if c.strip()]:
        df = df.withColumn("_w", F.replace(F.col("_w"), F.lit(term), F.lit("")))
    return df.select(*keys, key, F.col("_w").alias("tokenised"), F.concat("_map", extra).alias("token_map"), "pii_stripped")


def detokenise_text(df: DataFrame, text: str, token_map: str, out: str) -> DataFrame:
    """Put the originals back, longest token first (T001 must not match inside T0010)."""
    order = F.array_sort(F.transform(token_map, lambda t: F.struct(
        (-F.length(t["token"])).alias("neg"), t["token"].alias("token"), t["original"].alias("original"))))
    return df.withColumn(out, F.aggregate(order, F.col(text), lambda acc, t: F.replace(acc, t["token"], t["original"])))


def corpus_tokens(entities: DataFrame, keys: list[str]) -> DataFrame:
    """One token per distinct (category, value) over a whole corpus, numbered by value.

    The numbers need a per-category order; ranking runs on the distinct values only.
    """
    values = entities.select(*keys, "category", "value").distinct()
    n = F.dense_rank().over(Window.partitionBy(*keys, "category").orderBy("value"))
    return values.withColumn("token", F.concat("category", F.lit("_T"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0"))
                                               .otherwise(n.cast("string"))))


def mask_audit(log: DataFrame, limit: int = 50) -> DataFrame:
    """The newest calls of each ledger with the masked items in total; unreadable JSON counts as none."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    parsed = F.from_json("masked_json", "array<struct<category:string,count:int>>")
    total = F.aggregate(F.coalesce(parsed, F.array().cast("array<struct<category:string,count:int>>")), F.lit(0),
                        lambda acc, m: acc + F.coalesce(m["count"], F.lit(0)))
    newest = top_per(log, ["ledger_id"], [F.col("created_at").desc(), F.col("call_id").desc()], limit)
    return newest.select("ledger_id", "call_id", "model", total.alias("masked_total"))


# --- language and safety -------------------------------------------------------------

# fixed values: romanised Hindi -> English
HINGLISH = {
    "dikhao": "show", "batao": "tell", "nikalo": "extract", "laao": "get", "dhoondo": "find",
    "kitna": "how much", "kitne": "how many", "kul": "total", "baaki": "outstanding", "baki": "balance",
    "raashi": "amount", "upar": "above", "neeche": "below", "zyada": "more than", "kam": "less than",
    "mahine": "month", "mahina": "month", "saal": "year", "pichle": "last", "agle": "next", "abhi": "current",
    "aaj": "today", "se": "from", "tak": "to", "ke": "of", "mein": "in", "khata": "account", "jama": "credit",
    "udhar": "debit", "bhaari": "overdue", "bikri": "sales", "khareed": "purchase", "kharcha": "expense",
    "amdani": "income", "munafa": "profit", "nuksan": "loss", "karod": "crore", "hazaar": "thousand",
    "lakh": "lakh", "rupaye": "rupees", "vendor": "vendor", "party": "vendor", "dukan": "business",
    "grahak": "customer", "sabhi": "all",
}


def normalise_hinglish(text: Column) -> Column:
    """Whole known words to English; a capital first letter marks a name and is left alone."""
    table = F.create_map(*[F.lit(x) for pair in HINGLISH.items() for x in pair])
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.when(w.rlike("^[A-Z]"), w).otherwise(
        F.coalesce(F.try_element_at(table, F.lower(w)), w))), "")


# fixed values: prompt and SQL injection patterns
INJECTION = [
    r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context|rules?)",
    r"(?i)disregard\s+(all\s+)?(previous|prior|above|earlier|your)",
    r"(?i)forget\s+(all\s+)?(previous|prior|above|your|the)\s+(instructions?|prompts?|context|rules?|training)",
    r"(?i)new\s+instructions?:",
    r"(?i)override\s+(your\s+)?(instructions?|rules?|constraints?|guidelines?)",
    r"(?i)you\s+are\s+now\s+(?!asking|going|about|in)",
    r"(?i)pretend\s+(to\s+be|you\s+are|that\s+you)",
    r"(?i)act\s+as\s+(a\s+|an\s+)?(different|another|new|unrestricted|unfiltered)",
    r"(?i)roleplay\s+as",
    r"(?i)from\s+now\s+on\s+(you\s+are|ignore|forget|act)",
    r"(?i)your\s+(true\s+)?(purpose|goal|mission|task|job)\s+is\s+(?!to\s+answer)",
    r"(?i)system\s*:\s*you\s+are",
    r"(?i)\[INST\]", r"(?i)<<SYS>>", r"(?i)<\|system\|>", r"(?i)<\|user\|>", r"(?i)<\|assistant\|>",
    r"\bDAN\b", r"(?i)developer\s+mode", r"(?i)jailbreak", r"(?i)unrestricted\s+mode", r"(?i)no\s+restrictions?",
    r"(?i)bypass\s+(your\s+)?(safety|filter|guardrail|rule|restriction|limit)",
    r"(?i)'\s*(?:or|and)\s+'?\s*'?1'?\s*=\s*'?1",
    r"(?i);\s*(?:DROP|DELETE|INSERT|UPDATE|ALTER|TRUNCATE|CREATE)\s+",
    r"(?i)UNION\s+(?:ALL\s+)?SELECT",
    r"(?i)--\s*(?:password|admin|select|drop|delete)",
    r"(?i)(?:repeat|print|output|reveal|show|tell\s+me)\s+(your\s+)?(system\s+)?prompt",
    r"(?i)(?:what\s+(?:are|were)\s+your|tell\s+me\s+your)\s+instructions?",
    r"(?i)(?:leak|expose|extract)\s+(your\s+)?(system|instructions?|prompt|context)",
]
# fixed values: finance vocabulary
FINANCE = [
    r"(?i)\b(?:balance|debit|credit|ledger|journal|account|accounts?)\b",
    r"(?i)\b(?:transaction|entry|entries|voucher|posting)\b",
    r"(?i)\b(?:invoice|bill|receipt|payment|payable|receivable)\b",
    r"(?i)\b(?:vendor|supplier|creditor|debtor|customer|client|party)\b",
    r"(?i)\b(?:revenue|income|expense|cost|profit|loss|margin)\b",
    r"(?i)\b(?:cash|bank|fund|liquidity|balance\s+sheet)\b",
    r"(?i)\b(?:asset|liability|equity|capital|reserve|provision)\b",
    r"(?i)\b(?:report|summary|statement|register|schedule|breakdown|analysis|drill)\b",
    r"(?i)\b(?:aging|outstanding|overdue|pending|dues?)\b",
    r"(?i)\b(?:budget|forecast|variance|actual|target|projection)\b",
    r"(?i)\b(?:reconcil|recon)\b",
    r"(?i)\b(?:depreciation|amortis|write.?off)\b",
    r"(?i)\b(?:monthly|quarterly|annual|yearly|fiscal|period|year.?end|month.?end|quarter)\b",
    r"\b(?:GST|CGST|SGST|IGST|TDS|TCS|PAN|MSME|ITR)\b",
    r"(?i)\b(?:lakh|crore|INR|rupee)\b",
    r"(?i)\b(?:purchase|sales?|debtors?|creditors?|payroll|salary|salaries|wage)\b",
    r"(?i)\b(?:cost\s+cent(?:er|re)|department|branch|project|division)\b",
    r"(?i)\b(?:fixed\s+asset|working\s+capital|current\s+ratio|debt.?equity)\b",
    r"(?i)\b(?:intercompany|multi.?currency|exchange\s+rate|forex)\b",
    r"(?i)\b(?:khata|bakaya|vyapari|grahak|kharcha|aay|munafa|nuksaan|nakad)\b",
    r"(?i)\b(?:lenadar|denadaar|tankhwah|bikri|kharid|vibhag|milaan|rajaswa)\b",
    r"(?i)\b(?:sampatti|mulya|hrass|saalon|mahine|timahi|saal)\b",
    r"(?i)\b(?:dikhao|batao|kitna|kitne|pichli|sabse|baaki)\b",
]


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that is one ``(?:a|b|...)`` to begin with, else the pattern."""
    if not pattern.startswith("(?:"):
        return [pattern]
    out, depth, at = [], 0, 3
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if (c == "|" and depth == 1) or depth == 0:
            out.append(pattern[at:i])
            at = i + 1
        if depth == 0:
            return [pattern] if pattern[i + 1:i + 2] in ("?", "*", "{") else out
    return [pattern]


def any_of(patterns: list[str]) -> str:
    """A pattern that finds what any of ``patterns`` finds, which are tried by their first letter.

    Those that begin at a word edge share one test of it.  All are tried only where a first letter stands.
    """
    groups: dict[tuple[bool, str], list[str]] = {}
    for p in patterns:
        bare = p.removeprefix("(?i)")
        edge = bare.startswith(r"\b")
        rest = bare.removeprefix(r"\b")
        firsts = sorted({a.removeprefix("\\")[:1] for a in _alternatives(rest)})
        plain = all(re.match(r"([A-Za-z<;'-]|\\\[)(?![?*{])", a) for a in _alternatives(rest))
        for c in firsts if plain else [""]:
            both = sorted({c.lower(), c.upper()}) if bare != p else [c]
            groups.setdefault((edge, "".join(both)), []).append(f"(?:{'(?i)' if bare != p else ''}{ascii_edges(rest)})")

    def tried(edge: bool) -> str:
        own = {first: "|".join(dict.fromkeys(ps)) for (e, first), ps in groups.items() if e == edge}
        return "|".join(f"(?=[{re.escape(first)}])(?:{ps})" if first else ps for first, ps in own.items())

    parts = [part for part in (tried(False), f"{WORD_EDGE}(?:{tried(True)})" if tried(True) else "") if part]
    return "|".join(parts)


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike(any_of(patterns))


def flag_injection(text: Column) -> Column:
    return _any(text, INJECTION)


def is_financial(text: Column) -> Column:
    return _any(text, FINANCE)


def guardrail(text: Column) -> Column:
    """injection / financial / unknown, in that order."""
    return F.when(flag_injection(text), "injection").when(is_financial(text), "financial").otherwise("unknown")
