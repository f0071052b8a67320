"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to a fixed number of buckets.
Two multinomials over the buckets are estimated: one from trusted documents, one
from the whole raw corpus.  A document's score is the mean over its n-grams of
log(trusted / raw).  Every document is compared with one threshold, so the same
document always gets the same verdict.

All steps are built-in expressions.  The raw counts combine map-side into at
most ``BUCKETS`` rows; the model that the scoring pass needs is that many
numbers, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, order_id, word_array
from .lm_scoring import _marked as marked

BUCKETS = 10_000
#: Share of trusted rows that the threshold lets fall.
TRUSTED_LOSS = 0.002
WINDOW = 5
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@dataclass(frozen=True)
class Model:
    """``ratios``: log(trusted / raw) of each bucket; ``threshold``: the least score that is kept."""

    ratios: tuple[float, ...]
    threshold: float


def _pairs(items: Column, f) -> Column:
    """``f`` of each element and the next."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), f)


def sorted_windows(grams: Column) -> Column:
    """The windows (hash, place) in order of their hashes where two are equal, else null; ``grams`` has the hash of each window in order."""
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))


def repeat_words(placed: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``placed``: a column of ``sorted_windows``."""
    hits = F.flatten(_pairs(placed, lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    starts = F.array_sort(F.array_distinct(hits))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
                          lambda acc: acc["n"])
    return F.when(placed.isNull(), F.lit(0)).otherwise(covered)


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__h``, the hash of each word of the text, and ``__h2``, of each pair of neighbours."""
    words = docs.withColumn("__h", F.transform(word_array(text), lambda w: F.xxhash64(w)))
    return words.withColumn("__h2", _pairs(F.col("__h"), lambda a, b: F.xxhash64(a, b)))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RULES``, ``__h`` and ``__h2``.

    A missing or blank text has no words and fails.  A line counts as repeated if it has a word and equals an
    earlier line of its text.  Columns of ``docs`` with these names are replaced.
    """
    plain = [c for c in docs.columns if c not in RULES]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    n = F.size("__h")
    count = F.greatest(n - (WINDOW - 1), F.lit(0))
    four = F.zip_with(F.slice("__h2", F.lit(1), count), F.slice("__h2", F.lit(3), count), lambda a, b: F.xxhash64(a, b))
    out = hashed(docs.select(*plain), text).withColumns({"__lines": lines, "__four": four})
    grams = F.zip_with("__four", F.slice("__h", F.lit(WINDOW), count), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("__grams", grams).withColumn("__placed", sorted_windows(F.col("__grams"))).withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__placed")).cast("long")})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__lines", "__four", "__grams", "__placed")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def score(ratios: tuple[float, ...]) -> Column:
    """Mean log-likelihood ratio over ``__h`` and ``__h2``; 0 without words."""
    table = F.lit(list(ratios))
    total = F.aggregate("__h", F.lit(0.0), lambda acc, h: acc + F.get(table, _bucket(h)))
    total = F.aggregate("__h2", total, lambda acc, h: acc + F.get(table, _bucket(h)))
    return total / F.greatest(2 * F.size("__h") - 1, F.lit(1))


#: Accuracy of the approximate ranks that enclose an exact quantile.
RANKS = 10_000


def quantile(values: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a column, between two values by linear interpolation; None without values.

    Approximate quantiles on either side enclose it, so only about 6 / RANKS of the values are put in order.
    """
    sides = [max(0.0, share - 3 / RANKS), min(1.0, share + 3 / RANKS)]
    n, least, most, near = values.agg(F.count(column), F.min(column), F.max(column), F.percentile_approx(column, sides, RANKS)).first()
    if not n:
        return None
    low = least if sides[0] == 0 else near[0]
    high = most if sides[1] == 1 else near[1]
    place = (n - 1) * share
    first, last = floor(place), ceil(place)
    below, within = values.agg(F.count_if(F.col(column) < low), F.count_if(F.col(column).between(low, high))).first()
    if not below <= first or not last < below + within:  # the bounds are approximate; all values are certain
        low, high, below = least, most, 0
    inside = values.filter(F.col(column).between(low, high)).select(column).orderBy(column)
    a, *b = [r[0] for r in inside.offset(first - below).limit(last - first + 1).collect()]
    return a if not b or a == b[0] else (last - place) * a + (place - first) * b[0]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        trusted_loss: float = TRUSTED_LOSS) -> Model:
    """Raw counts from every document, trusted counts from every document labelled 1.

    The threshold is the quantile ``trusted_loss`` of the scores of all trusted documents.  Without labels or documents
    all ratios are 0 and everything passes.  Trusted ids meet the texts as broadcast bitmaps; no text is shuffled.
    """
    ids = labels.filter(F.col(label) == 1).select(F.col(doc_id).cast("long").alias("__id")).filter("__id IS NOT NULL").distinct()
    rows = marked(docs.select(order_id(doc_id).alias("__id"), F.col(text).alias("text")), ids).select("text", (F.col("t") == 1).alias("t"))
    counts = (hashed(rows).select(F.explode(F.concat("__h", "__h2")).alias("h"), "t").select(_bucket(F.col("h")).alias("bucket"), "t")
              .groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("t").alias("trusted")).collect())
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:  # at most BUCKETS rows
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["trusted"]
    norm = log((sum(raw) + BUCKETS) / (sum(good) + BUCKETS))
    ratios = tuple(log((g + 1) / (r + 1)) + norm if sum(good) else 0.0 for g, r in zip(good, raw, strict=True))
    # one number a trusted document
    least = quantile(cut(hashed(rows.filter("t")).select(score(ratios).alias("s")), "trusted-scores"), "s", trusted_loss)
    return Model(ratios, float("-inf") if least is None else least)


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the base rules, ``score`` and ``kept``: false if the base failed, else score >= threshold."""
    plain = [c for c in docs.columns if c not in (*RULES, "score", "kept")]
    out = base_rules(docs.select(*plain), text).withColumn("score", score(model.ratios))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.threshold)).drop("__h", "__h2")
