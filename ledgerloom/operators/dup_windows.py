"""Duplicate pairs as intervals: one row a posting group, from which every pair follows.

Rows of one key (ledger, party, amount) are numbered by day.  The partners of a row that come after it
are then one run of numbers, ``first`` to ``last``, less the rows of its own reference.  The table grows with the
rows, not with the pairs, and ``expand`` turns any part of it into pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .checks import DUP_DAYS, KEY, L, Ledger, _dup_rows


def dup_windows(gl: Ledger) -> DataFrame:
    """(ledger, party, amount, vch, date, copies, slot, first, last, partners).

    One row for each (key, day, reference) that has a key, an amount above the least and a reference; ``copies`` are its
    ledger rows.  ``first`` > ``last`` means that no row follows within seven days.  ``partners`` are the ledger rows
    with another reference between them, so ``sum(copies * partners)`` is the number of pairs.  An empty ledger gives no rows.

    Numbers are dealt in two steps, over slices of a key's day by a hash of the reference and then inside a slice, so
    that neither a hot key nor a hot day is sorted in one task.
    """
    rows = _dup_rows(gl).withColumn("slice", F.substring(F.md5("ref"), 1, 2))
    slices = rows.groupBy(*KEY, "day", "slice").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m"))
    # at most 256 slices a day: a key's order has as many rows as its days allow, whatever its postings
    whole = Window.partitionBy(*KEY).orderBy("day", "slice")
    ahead = whole.rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy(*KEY).orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, DUP_DAYS)
    slices = slices.select(*KEY, "day", "slice", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("k0"), F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("m0"),
                           F.sum("k").over(near).alias("last"), F.sum("m").over(near).alias("m1"))
    inside = Window.partitionBy(*KEY, "day", "slice").orderBy("ref")
    same = Window.partitionBy(*KEY, "ref").orderBy(F.unix_date("day")).rangeBetween(1, DUP_DAYS)
    rows = rows.withColumns({"i": F.row_number().over(inside), "m": F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                             "own": F.coalesce(F.sum("n").over(same), F.lit(0))})
    return rows.join(slices, [*KEY, "day", "slice"]).select(
        L, "party", F.col("amount").cast("double").alias("amount"), F.col("ref").alias("vch"), F.col("day").alias("date"), F.col("n").alias("copies"),
        (F.col("k0") + F.col("i")).alias("slot"), (F.col("k0") + F.col("i") + 1).alias("first"), "last",
        (F.col("m1") - F.col("m0") - F.col("m") - F.col("own")).alias("partners"))


def expand(windows: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(ledger, party, amount, vch_a, date_a, vch_b, date_b, pairs): the pairs whose earlier row is in ``chosen`` (all rows by default).

    ``vch_a`` is the smaller reference; ``pairs`` multiplies the copies of both.  The result is as long as the
    pairs are many: choose a ledger, a party or a voucher where a key is hot.
    """
    key = [L, "party", "amount"]
    left = (windows if chosen is None else chosen).filter("partners > 0").select(
        *key, F.col("vch").alias("v1"), F.col("date").alias("d1"), F.col("copies").alias("c1"), F.explode(F.sequence("first", "last")).alias("slot"))
    right = windows.select(*key, "slot", F.col("vch").alias("v2"), F.col("date").alias("d2"), F.col("copies").alias("c2"))
    both = left.join(right, [*key, "slot"]).filter("v1 <> v2")
    swap = F.col("v1") < F.col("v2")
    return both.select(*key, F.least("v1", "v2").alias("vch_a"), F.when(swap, F.col("d1")).otherwise(F.col("d2")).alias("date_a"),
                       F.greatest("v1", "v2").alias("vch_b"), F.when(swap, F.col("d2")).otherwise(F.col("d1")).alias("date_b"),
                       (F.col("c1") * F.col("c2")).alias("pairs"))
