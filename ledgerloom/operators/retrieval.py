"""Retrieval over past questions and confirmed knowledge: token overlap, and vector top-k through a partitioned index.

All past questions and all knowledge rows are searched.  Candidates come from
equi-joins on (ledger, token); question similarity joins only the rarest tokens
of each side (prefix filtering, exact), so common words bring no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import top_per
from . import vector_index
from .vector_index import VectorIndex

L = "ledger_id"

# fixed values: words left out of question similarity
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can", "need", "dare", "ought", "in", "on", "at",
    "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above",
    "below", "between", "out", "off", "over", "under", "again", "further", "and", "but", "or", "nor", "so", "yet",
    "both", "either", "neither", "not", "only", "own", "same", "than", "too", "very", "just", "me", "my", "show",
    "give", "get", "list", "tell", "find", "all", "its", "ka", "ki", "ke", "ko", "se", "me", "hai", "hain", "tha",
    "the", "kya", "yeh", "woh", "aur", "ya", "jo", "jab", "tab",
]
# fixed values: discriminative finance terms
FINANCE_TERMS = [
    "aging", "outstanding", "overdue", "payable", "receivable", "vendor", "customer", "debtor", "creditor", "balance",
    "revenue", "expense", "salary", "gst", "tds", "monthly", "quarterly", "annual", "weekly", "top", "highest",
    "lowest", "summary", "ledger", "baaki", "udhar", "jama", "mahine", "saal", "bikri",
]
FINANCE_BOOST = 0.05
MIN_SIMILARITY, MIN_CONFIDENCE, MAX_AGE_DAYS, ENOUGH = 0.3, 0.7, 180, 3


def question_tokens(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9_\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS)))


def _similarity(shared: Column, finance: Column, left: Column, right: Column) -> Column:
    jaccard = shared / (left + right - shared)
    return F.least(F.lit(1.0), jaccard + finance * F.lit(FINANCE_BOOST))


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the token sets plus 0.05 per shared finance term, at most 1."""
    ta, tb = question_tokens(a), question_tokens(b)
    shared = F.array_intersect(ta, tb)
    finance = F.size(F.filter(shared, lambda t: t.isin(FINANCE_TERMS)))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(
        _similarity(F.size(shared), finance, F.size(ta), F.size(tb)))


def good_examples(log: DataFrame, as_of: str) -> DataFrame:
    """Past questions fit to serve as examples."""
    return log.filter(
        (F.col("status") == "COMPLETED") & F.col("generated_sql").isNotNull()
        & (F.col("confidence") >= MIN_CONFIDENCE)
        & (F.col("created_at") >= F.date_sub(F.lit(as_of).cast("date"), MAX_AGE_DAYS))
        & (F.col("row_count").isNull() | (F.col("row_count") > 0))
        & (F.col("feedback").isNull() | (F.col("feedback") != "thumbs_down")))


def _prefix(rows: DataFrame, rarity: DataFrame, keys: list[str]) -> DataFrame:
    """The rarest tokens of each row, as many as a similar row must meet at least one of.

    A row of n tokens needs more than 0.3 n / (1 + 0.05 n) shared ones: the
    other side cannot be smaller than what is shared, and each shared token
    adds at most 0.05.  Two rows that share m tokens meet within the first
    n - m + 1 of either in any fixed order.
    """
    ranked = rows.select(*keys, F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(rarity, "token", "left").withColumn(
        "pos", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("seen", F.lit(0)), "token")))
    # a hair below the bound, so that rounding can only add candidates
    need = F.floor(F.lit(MIN_SIMILARITY) * F.col("n") / (1 + FINANCE_BOOST * F.col("n")) - 1e-9) + 1
    return ranked.filter(F.col("pos") <= F.col("n") - need + 1).select(*keys, "token")


def _scored(asked: DataFrame, examples: DataFrame, own: bool) -> DataFrame:
    """Pairs above the least similarity, within the ledger (``own``) or with all other ledgers."""
    rarity = examples.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    e = _prefix(examples, rarity, ["query_id", L]).withColumnRenamed(L, "example_ledger")
    q = _prefix(asked, rarity, ["question_id", L])
    met = q.join(e, "token").filter(F.col("example_ledger") == F.col(L) if own else F.col("example_ledger") != F.col(L))
    pairs = met.select("question_id", L, "query_id").distinct()
    pairs = pairs.join(asked.select("question_id", L, F.col("tokens").alias("qt")), ["question_id", L]).join(
        examples.select("query_id", "created_at", F.col("tokens").alias("et")), "query_id")
    shared = F.array_intersect("qt", "et")
    finance = F.size(F.filter(shared, lambda t: t.isin(FINANCE_TERMS)))
    sim = _similarity(F.size(shared), finance, F.size("qt"), F.size("et"))
    return pairs.withColumn("raw", sim).filter(F.col("raw") > MIN_SIMILARITY).select(
        L, "question_id", F.col("query_id").alias("example_id"), "created_at", F.round("raw", 6).alias("similarity"))


def similar_questions(asked: DataFrame, log: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    """The ``k`` best examples for each asked question.

    ``asked``: (ledger_id, question_id, question).  All good examples of the own
    ledger come first; only when fewer than three of them are similar, those of
    all other ledgers follow.
    """
    examples = good_examples(log, as_of).select(
        L, "query_id", "created_at", question_tokens(F.col("question")).alias("tokens"))
    asked = asked.select(L, "question_id", question_tokens(F.col("question")).alias("tokens"))
    near = _scored(asked, examples, own=True).withColumn("path", F.lit(1))
    enough = near.groupBy(L, "question_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= ENOUGH)
    rest = asked.join(enough, [L, "question_id"], "left_anti")
    far = _scored(rest, examples, own=False).withColumn("path", F.lit(2))
    order = [F.col("path"), F.col("similarity").desc(), F.col("created_at").desc(), F.col("example_id").desc()]
    w = Window.partitionBy(L, "question_id").orderBy(*order)
    return near.unionByName(far).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        L, "question_id", "example_id", "path", "rank", "similarity")


# --- vectors -----------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        prod = F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double"))
        return F.aggregate(prod, F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(queries: DataFrame, index: VectorIndex, k: int = 5, min_similarity: float = 0.5) -> DataFrame:
    """Exact nearest knowledge rows of the same ledger for each query vector, through the index; rejected rows never show.

    ``queries``: (ledger_id, question_id, query_vector).  ``k`` is at least 1.
    """
    return vector_index.search(queries, index, k, min_similarity)


# --- keywords ----------------------------------------------------------------------

# fixed values: words left out of knowledge search
NOISE_WORDS = [
    "the", "is", "at", "of", "on", "and", "a", "an", "to", "in", "for", "with", "by", "this", "that", "it", "be",
    "are", "was", "were", "or", "if", "but", "not", "do", "does", "did", "have", "has", "had", "you", "your", "we",
    "us", "our", "i", "my", "me", "amount", "balance", "total", "entry", "entries", "period", "close", "report",
    "data", "show", "tell", "get", "want", "need", "please", "help",
]
MIN_KNOWLEDGE_CONFIDENCE, FRESH_DAYS = 0.4, 365


def stem(w: Column) -> Column:
    n = F.length(w)
    return (F.when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
            .when(w.endswith("es") & (n > 4), F.substring(w, F.lit(1), n - 2))
            .when(w.endswith("s") & (n > 3), F.substring(w, F.lit(1), n - 1))
            .when(w.endswith("ing") & (n > 5), F.substring(w, F.lit(1), n - 3))
            .when(w.endswith("ed") & (n > 4), F.substring(w, F.lit(1), n - 2)).otherwise(w))


def keywords(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(NOISE_WORDS))
    return F.array_distinct(F.transform(kept, stem))


def keyword_retrieval(prompts: DataFrame, knowledge: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    """Overlap x trust x freshness over all usable rows of a ledger, top ``k`` per prompt.

    ``prompts``: (ledger_id, question_id, question).
    """
    usable = knowledge.filter((F.col("verdict") != "REJECTED") & (F.col("confidence") >= MIN_KNOWLEDGE_CONFIDENCE))
    trust = F.col("confidence") * F.least(F.lit(2.0), 1 + F.log10("reaffirmation_count"))
    age = F.datediff(F.lit(as_of).cast("date"), "last_reaffirmed_at")
    fresh = F.when(age < FRESH_DAYS, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (age - FRESH_DAYS) / 730))
    rows = usable.select(L, "answer_id", (trust * fresh).alias("weight"),
                       F.explode(keywords(F.concat_ws(" ", "context", "answer"))).alias("word"))
    asked = prompts.select(L, "question_id", F.explode(keywords(F.col("question"))).alias("word"))
    hits = asked.join(rows, [L, "word"]).groupBy(L, "question_id", "answer_id").agg(
        F.count(F.lit(1)).alias("overlap"), F.first("weight").alias("weight"))
    scored = hits.select(L, "question_id", "answer_id", F.round(F.col("overlap") * F.col("weight"), 6).alias("score"))
    return top_per(scored, [L, "question_id"], [F.col("score").desc(), F.col("answer_id")], k)


def knowledge_context(prompts: DataFrame, queries: DataFrame, knowledge: DataFrame, index: VectorIndex, as_of: str, k: int = 5) -> DataFrame:
    """Vector matches of at least 0.55 where a prompt has any, else keyword matches."""
    by_vector = vector_topk(queries, index, k, 0.55).select(
        L, "question_id", "answer_id", F.lit("vector").alias("retrieval"), F.col("similarity").alias("score"))
    rest = prompts.join(by_vector.select(L, "question_id").distinct(), [L, "question_id"], "left_anti")
    by_word = keyword_retrieval(rest, knowledge, as_of, k).select(
        L, "question_id", "answer_id", F.lit("keyword").alias("retrieval"), "score")
    return by_vector.unionByName(by_word)


def query_log_page(log: DataFrame, limit: int, status: str | None = None, verdict: str | None = None,
                   ledger_id: int | None = None, date_from: str | None = None, date_to: str | None = None,
                   cursor: tuple[str, int] | None = None) -> DataFrame:
    """Newest first; ``cursor`` is (created_at, query_id) of the last row already seen (keyset paging, no offset)."""
    for column, value in (("status", status), ("verdict", verdict), (L, ledger_id)):
        if value is not None:
            log = log.filter(F.col(column) == value)
    if date_from is not None:
        log = log.filter(F.col("created_at") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        log = log.filter(F.col("created_at") <= F.lit(date_to).cast("date"))
    if cursor is not None:
        day, last = F.lit(cursor[0]).cast("date"), cursor[1]
        log = log.filter((F.col("created_at") < day) | ((F.col("created_at") == day) & (F.col("query_id") < last)))
    return log.orderBy(F.col("created_at").desc(), F.col("query_id").desc()).limit(limit)
