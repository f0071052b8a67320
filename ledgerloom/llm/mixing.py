"""Mixing sources to target weights with hash-threshold histograms.

Every row has a hash of its id and text, so a share of a source is all its rows
below a hash threshold.  Sizes are summed by source and hash bucket; the bucket
in which a source's budget ends is found from cumulative sums, and only that
bucket is divided again by the next bits of the hash, until one hash value is
left.  No row is sorted; a row is kept by comparing its hash with a threshold.
Thresholds nest: a larger budget takes all rows of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_array

BITS = 60
STEP = 12


def row_hash(doc_id: str, text: str) -> Column:
    """60 bits of the MD5 of id and text: the same in every run and on every layout."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\n"),
                            F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target``: budgets by weight, none above ``most`` times its source's size.

    ``sizes`` has one row per source.  Sources in code-point order, a missing one last, take the weights in turn.
    What a capped source leaves is shared among the others by weight until none is above its cap, which is
    one level: sources sorted by cap per weight are capped as long as the level lies above theirs.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * most})
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    level = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "before": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))})
    left = (F.col("total") - F.col("before")).cast("double")
    level = level.withColumn("capped", F.col("cap") * F.col("rest").cast("double") < left * F.col("weight"))
    free = level.withColumns({
        "spent": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything),
        "shared": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)})
    share = (F.col("total") - F.col("spent")).cast("double") * F.col("weight") / F.col("shared").cast("double")
    return free.select("source", "source_size",
                       F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, threshold``: rows of at most that hash come nearest to ``need``; -1 takes none."""
    open_ = budgets.filter("need > 0").select("source", "need", F.lit(0.0).alias("before"))
    inside, done, shift = rows, None, BITS
    while shift:
        shift -= STEP
        bucket = F.shiftright("hash", shift)
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("here"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        upto = F.sum("here").over(Window.partitionBy("source").orderBy("bucket"))
        known = hist.join(open_.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        edge = (known.withColumn("upto", F.col("before") + upto).filter("upto >= need")
                .groupBy("source").agg(F.min_by(F.struct("bucket", "here", "low", "high", "upto", "need"), "bucket").alias("e"))
                .select("source", "e.*").withColumn("before", F.col("upto") - F.col("here")))
        edge = cut(edge, "edges")
        last = edge if shift == 0 else edge.filter("low = high")
        near = F.when(F.col("need") - F.col("before") > F.col("here") / 2, F.col("high")).otherwise(F.col("low") - 1)
        last = last.select("source", near.alias("threshold"))
        done = last if done is None else done.union(last)
        rest = edge.filter("low < high") if shift else edge.limit(0)
        if rest.isEmpty():
            break
        open_ = rest.select("source", "need", "before")
        on = rest.select(F.col("source").alias("of"), F.col("bucket").alias("at"))
        inside = cut(inside.join(on, F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("at"))).drop("of", "at"),
                     "boundary")
    return done


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``: how often the mix takes each row.

    A row's size is its number of words; a missing text has none.  The targets share the total size.  Every source
    is taken whole as often as its target allows, and the rest of the target by a hash threshold, so no row is taken
    more than ``most`` times and the words taken differ from the target by at most half of one row's size.  Repeated
    rows hash alike and are taken alike.  A missing source is a source of its own; one without words has target 0.
    An empty table gives an empty result.  Columns of ``docs`` with those four names are replaced.
    """
    plain = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    facts = docs.select(*plain).withColumns({"__size": F.size(word_array(text)).cast("long"),
                                             "__hash": row_hash(doc_id, text), "__source": F.col(source)})
    rows = cut(facts.select(F.col("__source").alias("source"), F.col("__size").alias("size"),
                            F.col("__hash").alias("hash")), "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = cut(goal.withColumn("whole", whole).withColumn(
        "need", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")), "targets")
    limit = _thresholds(rows, goal).withColumnRenamed("source", "of")
    goal = goal.join(limit, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("__of"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1)).alias("__threshold"))
    goal = cut(goal, "mix")
    taken = F.col("whole") + (F.col("__hash") <= F.col("__threshold")).cast("long")
    return facts.join(goal, F.col("__source").eqNullSafe(F.col("__of"))).select(
        *plain, F.col("__size").alias("size"), "source_size", "target", taken.alias("copies"))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as the mix takes it."""
    mixed = mix(docs, **options).filter("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
