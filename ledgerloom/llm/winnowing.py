"""Document fingerprints by winnowing.

Every run of ``K`` words has a hash, combined from the hashes of its words by
doubling, so neighbouring runs share the work.  Of every ``W`` neighbouring runs the
one of least hash is chosen, the rightmost of equals, and kept with its position.
Two texts that share ``W + K - 1`` words in a row share a chosen run.

A text of few words, or with words as long as in scripts without blanks, has too few such
runs: any edit would change all of them.  It is read by characters: its runs are of ``K`` characters,
white space being one blank.  A text has one fingerprint, and likeness is that of two fingerprints: a text read by characters and one
read by words share nothing.

A chosen run is one number: its 32-bit hash above the 31-bit complement of its
position, so that the least number is the least hash and, among equals, the
rightmost run.  Only built-in expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, order_id, real_id, word_array

K = 5
W = 8
LAST = 2**31 - 1
#: Texts of fewer words, or of more characters a word, are read by characters.
FEW_WORDS = 32
LONG_WORDS = 16


def _shifted(items: Column, by: int, f) -> Column:
    """``f`` of each element and the one ``by`` places on."""
    n = F.greatest(F.size(items) - by, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(1 + by), n), f)


def _both(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _chosen(df: DataFrame, units: Column, out: str, every: Column) -> DataFrame:
    """``df`` with ``out``: the chosen runs of a text's hashed units in order, as numbers.

    Fewer than K units are one run, none have none; of fewer than ``every`` runs all are chosen, or only the least where that is W.
    """
    t = [f"__{out}{i}" for i in range(5)]
    df = df.withColumn(t[0], units)
    df = df.withColumn(t[1], _shifted(F.col(t[0]), 1, _both))
    df = df.withColumn(t[2], _shifted(F.col(t[1]), 2, _both))
    n = F.greatest(F.size(t[0]) - (K - 1), F.lit(0))
    runs = F.zip_with(F.slice(t[2], F.lit(1), n), F.slice(t[0], F.lit(K), n), _both)
    runs = F.when(F.size(t[0]) >= K, runs).when(F.size(t[0]) > 0, F.array(F.xxhash64(F.col(t[0])))).otherwise(F.array().cast("array<bigint>"))
    packed = F.transform(runs, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(2**32 - 1)), 31).bitwiseOR((F.lit(LAST) - i).cast("long")))
    df = df.withColumn(t[3], packed)
    least = F.col(t[3])
    for i, by in enumerate((1, 2, 4)):
        df = df.withColumn(f"{t[4]}{i}", _shifted(least, by, lambda a, b: F.least(a, b)))
        least = F.col(f"{t[4]}{i}")
    short = F.when(every > W, F.col(t[3])).otherwise(F.array(F.array_min(t[3])))
    chosen = F.when(F.size(t[3]) >= every, F.array_distinct(least)).when(F.size(t[3]) > 0, short).otherwise(F.col(t[3]))
    return df.withColumn(out, chosen).drop(*t, *(f"{t[4]}{i}" for i in range(3)))


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the chosen runs of a text column in order, as numbers.

    A text of fewer than K units is one run; a missing or blank text has none.  Of fewer than W runs of words the least is chosen; of
    fewer than 2 W runs of characters all are, so a short text keeps what an edit leaves.
    """
    words, few = f"__{out}_words", f"__{out}_few"
    df = df.withColumn(words, word_array(text))
    df = df.withColumn(few, (F.size(words) < FEW_WORDS) | (F.length(text) > LONG_WORDS * F.size(words)))
    letters = F.filter(F.split(F.array_join(words, " "), ""), lambda c: c != "")
    units = F.transform(F.when(F.col(few), letters).otherwise(F.col(words)), lambda u: F.xxhash64(u))
    return _chosen(df, units, out, F.when(F.col(few), 2 * W).otherwise(W)).drop(words, few)


def spelt(runs: str | Column) -> Column:
    """A fingerprint as text; position = LAST - (number mod 2^31), hash = number div 2^31."""
    column = F.col(runs) if isinstance(runs, str) else runs
    return F.array_join(column.cast("array<string>"), " ")


def hashes(runs: str) -> Column:
    return F.array_distinct(F.transform(runs, lambda x: F.shiftright(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Shared chosen hashes over all chosen hashes, 0 to 1; two empty fingerprints are alike."""
    common = F.size(F.array_intersect(a, b))
    everything = F.size(a) + F.size(b) - common
    return F.when(everything == 0, F.lit(1.0)).otherwise(common / everything)


def followers(rows: DataFrame) -> DataFrame:
    """``row, next``: of distinct (id, row), the row next in order; after the last, the first.

    Rows are dealt by id range and linked inside each range; the ends of the ranges, one row each, are linked apart.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.distinct().repartitionByRange(n, "id", "row").withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy("id", "row")
    linked = dealt.select("part", "row", F.lead("row").over(inside).alias("next"))
    heads = dealt.groupBy("part").agg(F.min(F.struct("id", "row"))["row"].alias("head"))
    ends = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(ends), F.first("head").over(ends)).alias("after"))
    return linked.join(heads, "part").select("row", F.coalesce("next", "after").alias("next"))


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter of its characters replaced by the first as
    many (or all) of the next document in order of id, after the last the first.

    Columns: id, next_id, n_chars, edited, runs, edited_runs, near_edited, near_next.  A missing text counts as empty, a missing id
    as the largest; rows of one id follow each other by row hash, and equal rows come out alike.
    """
    own = docs.select(F.xxhash64(order_id(doc_id), F.col(text)).alias("row"), order_id(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = own.select("row", "id", F.length("text").alias("n_chars"))
    order = cut(followers(size.select("id", "row")), "order")
    ask = order.join(size.groupBy("row").agg(F.max(F.floor(F.col("n_chars") / 4)).cast("int").alias("quarter")), "row")
    ask = ask.select(F.col("next").alias("row"), F.col("row").alias("asker"), "quarter")
    told = own.join(ask, "row").select(F.col("asker").alias("row"), F.col("id").alias("next_id"), F.expr("substring(text, 1, quarter)").alias("head"), "text")
    told = fingerprinted(told, "text", "next_runs").select("row", "next_id", "head", hashes("next_runs").alias("next_hashes"))
    told = told.groupBy("row").agg(*(F.first(c).alias(c) for c in ("next_id", "head", "next_hashes")))
    both = own.join(told, "row").withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.col("head")))
    both = fingerprinted(fingerprinted(both, "text", "runs"), "edited", "edited_runs")
    near, near_next = likeness(hashes("runs"), hashes("edited_runs")), likeness(hashes("runs"), F.col("next_hashes"))
    return both.select(real_id("id").alias("id"), real_id("next_id").alias("next_id"), "n_chars", "edited", "runs", "edited_runs",
                       near.alias("near_edited"), near_next.alias("near_next"))
