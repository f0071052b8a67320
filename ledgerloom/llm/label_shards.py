"""Shards of equal row counts by balanced label propagation over links between documents.

Every document starts in a shard by its place in a hashed order, so that all
shards are equal.  Then rounds of joins follow: a document's neighbours vote
with their shards, a document that would cut fewer links elsewhere asks to
move, and each pair (from, to) of shards lets as many move as the quotas of
the linked documents allow.  Which of them move is decided by a threshold on
the size of their neighbourhood and their hash, found from a histogram and
exact in its boundary bucket: movers are not sorted, and no pair is one task.

Two neighbours never move in the same round: a document moves only while it
comes before all its neighbours, in rounds taken in turn by number of links
and by a hash drawn anew.  So each move lowers the number of cut links, and the
rounds end.  Documents without links are ballast: they fill the shards to
their exact quotas at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, order_id, real_id

SHARDS = 16
ROUNDS = 12
#: Hash buckets of the histogram of movers, in each class of neighbourhood size (a power of two).
BUCKETS = 1024
#: A node is a hub with this share of all link rows; there are fewer hubs than its inverse, so their labels can travel to every task.
HUB = 1 / 1024


def _ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``place``: its row number (from 0) in the order, which must not leave ties.  A distributed sort; one number a partition meets."""
    low = F.lit((1 << 33) - 1)
    mono = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*order).withColumns({"__part": F.shiftright(mono, 33), "__at": mono.bitwiseAND(low)}), name)
    sizes = sorted(rows.groupBy("__part").count().collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    table = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "__part bigint, __start bigint")
    return rows.join(F.broadcast(table), "__part").withColumn("place", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def _drawn(node: str | Column, round_: int) -> Column:
    """A hash of the node that is new in every round."""
    return F.xxhash64(F.lit(round_), F.col(node) if isinstance(node, str) else node)


def allowed(asked: np.ndarray, load: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """How many of ``asked[from, to]`` may move so that no load exceeds its quota.  The most first, then less into each full shard."""
    move = asked.copy()
    while True:
        over = load - move.sum(1) + move.sum(0) - quota
        full = np.flatnonzero((over > 0) & (move.sum(0) > 0))
        if not len(full):
            return move
        for j in full:
            came = int(move[:, j].sum())
            move[:, j] = move[:, j] * max(0, came - int(over[j])) // came


def _accepted(movers: DataFrame, quota: np.ndarray, load: np.ndarray, round_: int) -> DataFrame | None:
    """``node, want`` of those who may move; None if nobody may.

    ``movers``: ``node, shard, want, reach`` (most links a neighbour has).  Where not all may, those of small neighbourhoods go first:
    these fit a shard whole, while a group of many shards is parted anyway.
    """
    n = len(quota)
    size = F.floor(F.log2(F.col("reach").cast("double"))).cast("int") * BUCKETS
    movers = movers.withColumn("u", _drawn("node", -1 - round_)).withColumn("bucket", size + F.pmod("u", F.lit(BUCKETS)).cast("int"))
    asked = np.zeros((n, n), dtype=np.int64)
    for r in movers.groupBy("shard", "want").count().collect():
        asked[r.shard, r.want] = r["count"]
    may = allowed(asked, load, quota)
    if not may.any():
        return None
    if (may == asked).all():
        return movers.select("node", "want")
    limits = movers.sparkSession.createDataFrame(
        [(i, j, int(may[i, j])) for i in range(n) for j in range(n) if may[i, j]], "shard int, want int, may bigint")
    pair = Window.partitionBy("shard", "want")
    hist = movers.groupBy("shard", "want", "bucket").agg(F.count("*").alias("here")).join(F.broadcast(limits), ["shard", "want"])
    hist = hist.withColumn("upto", F.sum("here").over(pair.orderBy("bucket")))
    # one row a pair: the bucket in which its allowance ends, and how many of that bucket it covers
    edge = hist.filter("upto >= may AND upto - here < may").select(
        "shard", "want", F.col("bucket").alias("last"), (F.col("may") - F.col("upto") + F.col("here")).alias("take"))
    kept = movers.join(F.broadcast(edge), ["shard", "want"])
    inside = kept.filter("bucket = last").withColumn("at", F.row_number().over(pair.orderBy("u", "node"))).filter("at <= take")
    return kept.filter("bucket < last").select("node", "want").union(inside.select("node", "want"))


def propagate(nodes: DataFrame, links: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``node, shard`` of linked nodes, moved towards their neighbours' shards.

    ``nodes``: ``node`` (unique, long), ``shard`` (int) of the linked nodes, none above its quota; ``links``: ``a, b, weight`` between
    them.  Loops, missing ends and links to unknown nodes are left out; repeated links add up.  Links are followed both ways; the
    weighted number of cut links never rises.
    """
    spark = nodes.sparkSession
    good = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b", "weight")
    both = good.union(good.select("b", "a", "weight")).toDF("node", "other", "weight").groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    both = cut(both.join(nodes.select("node"), "node", "left_semi").join(nodes.select(F.col("node").alias("other")), "other", "left_semi"), "links")
    degree = cut(both.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    total = both.count()
    hubs = degree.filter(F.col("degree") > max(1, total * HUB)).select("node")
    # the neighbour's number of links stays with the link: the order of two neighbours needs no further join
    far = degree.select(F.col("node").alias("other"), F.col("degree").alias("other_degree"))
    hub_far = F.broadcast(far.join(F.broadcast(hubs.withColumnRenamed("node", "other")), "other", "left_semi"))
    to_hub = both.join(F.broadcast(hubs.withColumnRenamed("node", "other")), "other", "left_semi").join(hub_far, "other")
    to_node = both.join(F.broadcast(hubs.withColumnRenamed("node", "other")), "other", "left_anti").join(far, "other")
    columns = ["node", "other", "weight", "degree", "other_degree"]
    to_hub = cut(to_hub.join(degree, "node").select(*columns), "links-to-hubs")
    to_node = cut(to_node.join(degree, "node").select(*columns), "links-to-nodes")
    quotas, still = np.array(quota, dtype=np.int64), 0
    now = cut(nodes.select("node", F.col("shard").cast("int").alias("shard")), "labels")
    for r in range(rounds):
        label = now.select(F.col("node").alias("other"), F.col("shard").alias("their"))
        hub_label = F.broadcast(label.join(F.broadcast(hubs.withColumnRenamed("node", "other")), "other", "left_semi"))
        seen = to_hub.join(hub_label, "other").unionByName(to_node.join(label, "other"))
        mine, yours = (F.struct(d, _drawn(k, r), k) for d, k in (("degree", "node"), ("other_degree", "other"))) if r % 2 == 0 else (
            F.struct(_drawn(k, r), k) for k in ("node", "other"))
        votes = seen.groupBy("node", "their").agg(
            F.sum("weight").alias("votes"), F.min((mine < yours).cast("int")).alias("first"), F.max("other_degree").alias("reach"))
        votes = votes.join(now, "node")
        here = F.col("their") == F.col("shard")
        wish = votes.groupBy("node", "shard").agg(
            F.max(F.struct("votes", here.alias("stay"), (-F.col("their")).alias("less"))).alias("best"),
            F.sum(F.when(here, F.col("votes")).otherwise(0)).alias("held"), F.min("first").alias("first"), F.max("reach").alias("reach"))
        movers = cut(wish.filter("first = 1 AND best.votes > held AND NOT best.stay").select(
            "node", "shard", (-F.col("best.less")).alias("want"), "reach"), "movers")
        load = np.zeros(len(quota), dtype=np.int64)
        for row in now.groupBy("shard").count().collect():
            load[row.shard] = row["count"]
        moved = None if movers.isEmpty() else _accepted(movers, quotas, load, r)
        still = still + 1 if moved is None else 0
        if still == 2:
            break
        if moved is not None:
            now = cut(now.join(moved, "node", "left").select("node", F.coalesce("want", "shard").alias("shard")), "labels")
    return now


def cut_links(labels: DataFrame, links: DataFrame) -> int:
    """How many links have ends in two shards; ``labels``: ``node, shard``."""
    ends = [labels.select(F.col("node").alias(k), F.col("shard").alias(f"{k}_shard")) for k in ("a", "b")]
    return links.join(ends[0], "a").join(ends[1], "b").filter("a_shard <> b_shard").count()


def copy_links(rows: DataFrame, total: int, most: int) -> DataFrame:
    """``a, b, weight``: equal ``key`` rows as stars, one a piece of at most about ``most`` rows; the pieces' centres form a star too.

    ``rows``: ``node, key``, ``total`` of them.  As many links as rows at most, whatever the group; a group is never one task's: those
    with a share ``HUB`` of all rows, fewer than its inverse, meet their sizes and centres by broadcast.
    """
    groups = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    large = groups.filter(F.col("n") > total * HUB)
    small = groups.filter(F.col("n") <= total * HUB)
    piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / most))
    parts = []
    for held, hint in ((rows.join(F.broadcast(large), "key"), F.broadcast), (rows.join(small, "key"), lambda x: x)):
        held = held.withColumn("piece", piece)
        centres = cut(held.groupBy("key", "piece").agg(F.min("node").alias("b")), "centres")
        heads = centres.groupBy("key").agg(F.min("b").alias("head"))
        parts.append(held.select("key", "piece", F.col("node").alias("a")).join(hint(centres), ["key", "piece"]).select("a", "b"))
        parts.append(centres.join(heads, "key").select(F.col("b").alias("a"), F.col("head").alias("b")))
    spokes, bridges, more, rest = parts
    return spokes.union(bridges).union(more).union(rest).filter("a <> b").withColumn("weight", F.lit(1).cast("long"))


def shards(docs: DataFrame, links: DataFrame | None = None, n: int = SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: every row in a shard, counts at most one apart (law ``rows``).

    Linked documents are ``links`` (``a, b`` doc_ids, optional ``weight``) where given, else those of equal texts.  ``size`` is the
    text's UTF-8 bytes plus one, ``slot`` numbers a shard's rows from 0.  A missing text is empty and equals other empty ones; a
    missing doc_id is a document of its own that no given link reaches; a link to a shared doc_id reaches all its rows; repeated
    rows count each, and equal texts of theirs are linked; an empty table gives none.  ``grown_shard`` is null under this law.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(order_id(doc_id).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                       F.md5(body.cast("binary")).alias("key")).withColumn("h", F.xxhash64("id", "key"))
    rows = cut(_ranked(base, ["h", "id", "key"], "ranked").withColumnRenamed("place", "node"), "nodes")
    count = rows.count()
    quota = [count // n + (j < count % n) for j in range(n)]
    if links is None:
        found = copy_links(rows.select("node", "key"), count, max(2, count // n // 2))
    else:
        weight = F.col("weight") if "weight" in links.columns else F.lit(1)
        ends = [rows.filter(real_id("id").isNotNull()).select(F.col("id").alias(f"{k}_id"), F.col("node").alias(k)) for k in ("a", "b")]
        given = links.select(F.col("a").cast("long").alias("a_id"), F.col("b").cast("long").alias("b_id"), weight.cast("long").alias("weight"))
        found = given.join(ends[0], "a_id").join(ends[1], "b_id").select("a", "b", "weight")
    found = cut(found.filter("a <> b"), "found")
    linked = cut(found.select(F.col("a").alias("node")).union(found.select("b")).distinct(), "linked")
    start = linked.withColumn("shard", (F.col("node") % n).cast("int"))
    now = propagate(start, found, quota, rounds)
    load = {r.shard: r["count"] for r in now.groupBy("shard").count().collect()}
    # ballast: the k-th document without links goes where the k-th free place is
    loose = _ranked(rows.select("node").join(linked, "node", "left_anti"), ["node"], "loose")
    ends = np.cumsum([quota[j] - load.get(j, 0) for j in range(n)]).tolist()
    free = F.array_position(F.transform(F.array(*[F.lit(e) for e in ends]), lambda e: F.col("place") < e), True)
    placed = now.unionByName(loose.select("node", (free - 1).cast("int").alias("shard")))
    placed = rows.join(placed, "node").select("id", "size", "text_crc32", "shard", "node")
    first = np.concatenate([[0], np.cumsum(quota)]).tolist()
    slots = _ranked(placed, ["shard", "node"], "slots")
    offset = F.element_at(F.array(*[F.lit(f) for f in first]), F.col("shard") + 1)
    return slots.select(real_id("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                        (F.col("place") - offset).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
