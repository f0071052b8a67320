"""Connected components of a link table, by contraction.

Each round every node takes the smallest id among itself and its neighbours,
ids are chased twice, links inside one class vanish and the rest are mapped to
their classes.  Every node that is no local minimum merges, so the graph
shrinks each round.  All steps are joins and combinable minima; a hub only
makes a skewed join, which the runtime splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _chase(labels: DataFrame) -> DataFrame:
    up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return labels.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link; component is the smallest node id reachable.

    Loops, repeated links and null ends are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges = cut(edges, "links")
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        labels = cut(both.groupBy("node").agg(F.min("other").alias("label"))
                     .select("node", F.least("node", "label").alias("label")), "labels")
        labels = cut(_chase(_chase(labels)), "labels")
        if found is None:
            found = labels
        else:
            step = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            found = cut(found.join(step, "label", "left")
                        .select("node", F.coalesce("next", "label").alias("label")), "found")
        ends = [labels.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label")) for k in ("a", "b")]
        edges = cut(edges.join(ends[0], "a").join(ends[1], "b")
                    .select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
                    .filter("a <> b").distinct(), "links")
    if found is None:
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return found.select("node", F.col("label").alias("component"))
