"""Account and group hierarchies of any depth: closure, and types inherited from the nearest typed ancestor.

Both work by doubling: a round joins the paths known so far with each other, so
a tree of depth d takes about log2(d) rounds, not d.  A node is known within
its ledger.  Where an export gives a node several parents, the first by name
counts; a node that is its own parent is a root.  A cycle has no root: its
nodes are each other's ancestors, and without a typed node on the way those in
and below it get no type and are marked.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import stored

L = "ledger_id"


def parents(edges: DataFrame) -> DataFrame:
    """``ledger_id, node, parent`` of edges (ledger_id, child, parent): one parent a node, no loops, nothing missing."""
    good = edges.filter("child IS NOT NULL AND parent IS NOT NULL AND child <> parent")
    return good.select(L, F.col("child").alias("node"), "parent").distinct().groupBy(L, "node").agg(F.min("parent").alias("parent"))


def closure(edges: DataFrame) -> DataFrame:
    """``ledger_id, node, ancestor, distance``: every proper ancestor of every node with the least number of steps to it.

    In a cycle a node is not its own ancestor.  As many rows as the sum of the nodes' depths.
    """
    paths = stored(parents(edges).select(L, "node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "paths")
    known, reach = paths.count(), 1
    while True:
        # all paths of up to reach steps are known; only full-length ones can grow
        far = paths.filter(F.col("distance") == reach).withColumnRenamed("distance", "steps")
        on = paths.select(L, F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), "distance")
        more = far.join(on, [L, "ancestor"]).select(L, "node", F.col("above").alias("ancestor"), (F.col("steps") + F.col("distance")).alias("distance"))
        longer = paths.unionByName(more.filter("node <> ancestor")).groupBy(L, "node", "ancestor").agg(F.min("distance").alias("distance"))
        paths = stored(longer, "paths")
        now = paths.count()
        if now == known:
            return paths
        known, reach = now, 2 * reach


def inherited_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``ledger_id, node, account_type, typed_by, distance, is_cyclic``: one row a node of the edges or of ``types``.

    ``types``: (ledger_id, node, account_type), a type of null like none; of several the first by name counts.  A node's own type
    comes first, then that of the nearest typed ancestor (``typed_by``, ``distance`` steps above); without any both are null.
    """
    up = parents(edges)
    fixed = types.filter("node IS NOT NULL AND account_type IS NOT NULL").groupBy(L, "node").agg(F.min("account_type").alias("account_type"))
    nodes = up.select(L, "node").union(up.select(L, "parent")).union(types.filter("node IS NOT NULL").select(L, "node")).distinct()
    # at: how far a node has looked; open: nothing typed so far, and there is more above
    state = nodes.join(fixed, [L, "node"], "left").join(up, [L, "node"], "left").select(
        L, "node", "account_type", F.when(F.col("account_type").isNull(), F.col("parent")).alias("next"),
        F.when(F.col("account_type").isNotNull(), F.col("node")).alias("typed_by"), F.lit(0).cast("bigint").alias("distance"))
    state = stored(state.withColumn("distance", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("bigint")), "types")
    # a path without a cycle is shorter than the number of nodes
    for _ in range(ceil(log2(state.count() + 2)) + 1):
        if state.filter("next IS NOT NULL").isEmpty():
            break
        above = state.select(L, F.col("node").alias("next"), F.col("account_type").alias("a_type"), F.col("next").alias("a_next"),
                             F.col("typed_by").alias("a_by"), F.col("distance").alias("a_distance"))
        met = state.join(above, [L, "next"], "left")
        state = stored(met.select(
            L, "node", F.coalesce("account_type", "a_type").alias("account_type"), F.col("a_next").alias("next"),
            F.coalesce("typed_by", "a_by").alias("typed_by"),
            F.when(F.col("next").isNull(), F.col("distance")).otherwise(F.col("distance") + F.col("a_distance")).alias("distance")), "types")
    typed = F.col("account_type").isNotNull()
    return state.select(L, "node", "account_type", "typed_by", F.when(typed, F.col("distance")).alias("distance"),
                        F.col("next").isNotNull().alias("is_cyclic"))
