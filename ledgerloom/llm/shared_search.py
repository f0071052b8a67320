"""Ranked lexical search for many items at once, their common subexpressions computed once.

Mining.  Terms that occur in exactly the same items form one shared set, an
atom.  Each item is then a set of atoms; written in order of falling support,
items share prefixes, and the tree of these prefixes is the sharing plan: an
inner node is the sum of its parent's set and one atom, an item is its deepest
shared node plus the atoms it holds alone.  An atom feeds every node that needs
it, so terms, atoms, prefixes and items make a DAG.  Mining is linear in the
size of the items.

Evaluation.  A document holds all its terms, so its accumulators need no
shuffle: a block of documents is a matrix with one row a DAG node, each node
is filled once by adding the rows it depends on, and items read off theirs.
Only a task's best documents of each item leave it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, order_id, real_id

#: Terms of items (with repeats across items) that one plan holds; more items are answered in more blocks.
BLOCK_TERMS = 100_000
#: Numbers in one matrix of accumulators.
CELLS = 4_000_000
#: Parts in which the best documents of an item are merged first.
PARTS = 64

#: Bytes of a term stay, A-Z lower-cased; all other bytes part them.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Plan:
    """``terms`` are nodes 0, 1, ...; ``steps`` (node, nodes to add) follow in order; ``items`` name their node."""

    terms: list[bytes]
    steps: list[tuple[int, list[int]]]
    items: list[int]

    @property
    def nodes(self) -> int:
        return len(self.terms) + len(self.steps)

    @property
    def additions(self) -> int:
        """Rows added for one block of documents."""
        return sum(len(parts) for _, parts in self.steps)


def mine(items: list[set[bytes]]) -> Plan:
    """The sharing plan of the items' term sets.  An item without terms has node -1."""
    holders: dict[bytes, list[int]] = defaultdict(list)
    for i, held in enumerate(items):
        for term in held:
            holders[term].append(i)
    names = sorted(holders)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t, name in enumerate(names):
        alike[tuple(holders[name])].append(t)
    steps: list[tuple[int, list[int]]] = []

    def add(parts: list[int]) -> int:
        if len(parts) == 1:
            return parts[0]
        steps.append((len(names) + len(steps), parts))
        return steps[-1][0]

    shared: list[list[int]] = [[] for _ in items]
    own: list[list[int]] = [[] for _ in items]
    # widest support first: every item lists its atoms in this one order
    for owners, members in sorted(alike.items(), key=lambda x: (-len(x[0]), x[1])):
        if len(owners) == 1:
            own[owners[0]] += members
            continue
        atom = add(members)
        for i in owners:
            shared[i].append(atom)
    # the prefix tree: places[i] are the tree nodes on the way of item i
    children: dict[tuple[int, int], int] = {}
    users: Counter[int] = Counter()
    places: list[list[int]] = []
    for row in shared:
        at, way = -1, []
        for atom in row:
            at = children.setdefault((at, atom), len(children))
            way.append(at)
        users.update(way)
        places.append(way)
    made: dict[int, int] = {}
    roots = []
    for row, way, rest in zip(shared, places, own, strict=True):
        k, node = 0, -1
        while k < len(row) and users[way[k]] > 1:
            if way[k] not in made:
                made[way[k]] = add([node, row[k]] if k else [row[k]])
            node = made[way[k]]
            k += 1
        parts = ([node] if k else []) + row[k:] + rest
        roots.append(add(parts) if parts else -1)
    return Plan(names, steps, roots)


def _postings(names: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    place = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, counts = [], [], []
            for raw in batch.column(1):
                seen = Counter(terms(raw.as_py()))
                sizes.append(seen.total())
                hits = [(place[t], n) for t, n in seen.items() if t in place]
                ids.append([t for t, _ in hits])
                counts.append([n for _, n in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["id", "size", "terms", "tfs"])

    return run


def _rank(plan: Plan, weights: np.ndarray, total: int, length: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's ``k`` best documents of every item."""
    width = max(1, plan.nodes)
    block = max(1, min(2_048, CELLS // width))
    live = [i for i, node in enumerate(plan.items) if node >= 0]
    nodes = np.array([plan.items[i] for i in live], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((width, block), dtype=np.int64)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in live]
        least = np.ones(len(live), dtype=np.int64)

        def take(batch: pa.RecordBatch) -> None:
            docs, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = batch.column(2).offsets.to_numpy()
            lens = np.diff(starts)
            term = batch.column(2).values.to_numpy()[starts[0]:starts[-1]]
            tf = batch.column(3).values.to_numpy()[starts[0]:starts[-1]]
            row = np.repeat(np.arange(len(docs)), lens)
            m = 50 + (50 * size * total) // length
            grid[:len(plan.terms)] = 0
            grid[term, row] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
            for node, parts in plan.steps:
                np.add.reduce(grid[parts], axis=0, out=grid[node])
            scores = grid[nodes, :len(docs)]
            item, doc = np.nonzero(scores >= least[:, None])
            edges = np.searchsorted(item, np.arange(len(live) + 1))
            for i in np.unique(item):
                found = doc[edges[i]:edges[i + 1]]
                s, d = np.concatenate([best[i][0], scores[i, found]]), np.concatenate([best[i][1], docs[found]])
                order = np.lexsort((d, -s))[:k]
                best[i] = s[order], d[order]
                if len(order) == k:
                    least[i] = s[order[-1]]

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                take(batch.slice(at, block))
        for i, (s, d) in zip(live, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(d), pa.array(s)], ["item", "id", "score"])

    return run


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term``: the distinct terms of each item; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(raw.as_py()))) for raw in batch.column(1)]
            keys = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keys), pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, equal scores by ascending doc_id.

    Weights and scores are those of the query contract: integers, floors, one natural logarithm a term.  A missing text has no terms
    and never scores; a missing doc_id comes last among equal scores; repeated rows rank one after the other; rows that share an
    item_id (also a missing one) are one item with the terms of all.  Items without terms, and empty tables, give no rows.

    Items are answered in blocks of about ``block_terms`` terms (and at least one item), each with one plan that travels to the
    tasks; a block reads the documents once.
    """
    spark = docs.sparkSession
    wanted = cut(item_terms(items, item_id, text), "item-terms")
    blocks = max(1, -(-wanted.count() // block_terms))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = wanted.schema["item_id"].dataType.simpleString()
    ranked = None
    for b in range(blocks):
        rows = wanted.filter(F.col("block") == b).groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()
        if not rows:
            continue
        plan = mine([{bytes(t) for t in r.terms} for r in rows])
        source = docs.select(order_id(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
        posted = cut(source.mapInArrow(_postings(plan.terms), "id bigint, size bigint, terms array<int>, tfs array<bigint>"), "postings")
        total, length = posted.filter("size > 0").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not total:
            continue
        held = dict(posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(plan.terms))], dtype=np.int64)
        found = posted.filter(F.size("terms") > 0).mapInArrow(_rank(plan, weights, total, length, k), "item int, id bigint, score bigint")
        order = [F.col("score").desc(), F.col("id")]
        found = found.withColumn("part", F.spark_partition_id() % PARTS)
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("place") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        found = cut(found.join(names, "item").select("item_id", "rank", real_id("id").alias("doc_id"), "score"), "ranked")
        ranked = found if ranked is None else ranked.unionByName(found)
    if ranked is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return ranked
