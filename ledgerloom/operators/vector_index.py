"""Partitioned vector index: inverted lists under a coarse quantiser, probes, exact re-ranking, exact completion.

A quantiser (spherical k-means) is fitted on a bounded sample; every row is
filed under its nearest centre.  A list keeps, for each ledger, how many rows
it holds and how far the farthest lies from the centre.  A question probes its
nearest lists first.  What these cannot settle follows from the triangle
inequality of angles: a list none of whose rows can beat the k-th hit so far is
left out, all others are read, so the result equals a full search.  With
``exact=False`` the probes alone answer.

Rows and questions meet by (ledger, list).  Lists and question sets of more than
``CELL`` rows are dealt into a grid of cells, every pair of which meets in one
cell, so no key is one task's load and a cell's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import top_per

L = "ledger_id"
#: Rows the quantiser is fitted on, at most; the first of all rows in the order of a hash.
SAMPLE = 20_000
#: Centres, at most.
MOST_LISTS = 4_096
#: Rows, and questions, that one cell holds.
CELL = 8_192
#: Share of a ledger's lists a question probes first.
PROBED = 0.25
#: Similarities are compared after rounding to six digits.
SLACK = 1e-6

_UNIT = f"{L} int, answer_id bigint, list int, near double, unit array<double>"


def _units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows of ``dims`` numbers, and which rows these are; rows with missing, infinite or no length are left out."""
    at = np.flatnonzero(np.fromiter((x is not None and len(x) == dims for x in (column[i].as_py() for i in range(len(column)))), bool, len(column)))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
    size = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(size) & (size > 0)
    return flat[good] / size[good, None], at[good]


def fit(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centres of a spherical k-means; starts from evenly spaced rows of the sample, so it is the same in every run."""
    lists = max(1, min(lists, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        size = np.sqrt((total * total).sum(1))
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: ledger, answer, list, cosine to the centre, unit vector.  ``lists``: per ledger and list the rows and the least cosine."""

    rows: DataFrame
    lists: DataFrame
    centres: np.ndarray


def centres_of(rows: DataFrame, sample: int = SAMPLE, lists: int | None = None) -> np.ndarray:
    """The coarse quantiser: about the square root of the largest ledger's rows centres, at most ``MOST_LISTS``.

    ``rows``: ledger_id, answer_id, embedding.  Vectors of the most frequent length among the sample count.
    """
    largest = rows.groupBy(L).count().agg(F.max("count")).first()[0] or 1
    held = rows.select("embedding").orderBy(F.xxhash64(L, "answer_id"), "answer_id").limit(sample).toArrow().column(0).combine_chunks()
    lengths = [len(x) for x in held.to_pylist() if x]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    vectors, _ = _units(held, dims)
    if not len(vectors):
        return np.ones((1, dims))
    return fit(vectors, lists or min(MOST_LISTS, int(np.ceil(np.sqrt(largest)))))


def _filed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at = _units(batch.column(2), dims)
            near = unit @ centres.T
            own = near.argmax(1) if len(at) else np.empty(0, int)
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(keep), batch.column(1).take(keep), pa.array(own.astype(np.int32)), pa.array(near[np.arange(len(at)), own]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dims), pa.array(unit.ravel()))],
                [L, "answer_id", "list", "near", "unit"])

    typed = rows.select(F.col(L).cast("int"), F.col("answer_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    return typed.mapInArrow(run, _UNIT)


def build(knowledge: DataFrame, path: str, sample: int = SAMPLE, lists: int | None = None) -> VectorIndex:
    """Write the index of all usable rows under ``path``.

    ``knowledge``: ledger_id, answer_id, embedding, verdict.  Rejected rows, and vectors that are missing, of another length than
    most, infinite or all zero never show in a search and are not filed.  A list that many rows share is written to many files.
    """
    spark = knowledge.sparkSession
    usable = knowledge.filter(F.col("embedding").isNotNull() & (F.col("verdict") != "REJECTED")).select(L, "answer_id", "embedding")
    centres = centres_of(usable, sample, lists)
    rows = _filed(usable, centres)
    rows.repartitionByRange(L, "list", F.xxhash64("answer_id")).sortWithinPartitions(L, "list").write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.groupBy(L, "list").agg(F.count("*").alias("rows"), F.min("near").alias("least")).write.mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/centres")
    return VectorIndex(rows, spark.read.parquet(f"{path}/lists"), centres)


def load(spark, path: str) -> VectorIndex:
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/lists"), np.array([r.centre for r in centres]))


def _planned(questions: DataFrame, index: VectorIndex, k: int, probed: float, least: float) -> DataFrame:
    """``ledger, question_id, unit, first, rest``: the lists a question probes, and the others with the best similarity they can hold."""
    centres, dims = index.centres, index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at = _units(batch.column(2), dims)
            cosine = np.clip(unit @ centres.T, -1, 1)
            first, rest = [], []
            for row, i in enumerate(at):
                held = batch.column(3)[int(i)].as_py()
                names = np.array([x["list"] for x in held])
                size = np.array([x["rows"] for x in held])
                angle = np.arccos(cosine[row, names])
                # 1e-7: room for the rounding of two arc cosines
                bound = np.cos(np.maximum(0, angle - np.arccos(np.clip([x["least"] for x in held], -1, 1)) - 1e-7))
                live = bound >= least - SLACK
                order = np.argsort(angle, kind="stable")
                enough = int(np.searchsorted(np.cumsum(size[order]), k)) + 1
                cut = max(enough, int(np.ceil(probed * len(order))))
                first.append([int(names[j]) for j in order[:cut] if live[j]])
                rest.append([{"list": int(names[j]), "bound": float(bound[j])} for j in order[cut:] if live[j]])
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(keep), batch.column(1).take(keep),
                pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dims), pa.array(unit.ravel())),
                pa.array(first, pa.list_(pa.int32())), pa.array(rest, pa.list_(pa.struct([("list", pa.int32()), ("bound", pa.float64())])))],
                [L, "question_id", "unit", "first", "rest"])

    # one row a ledger, at most a list entry a centre
    table = index.lists.groupBy(L).agg(F.collect_list(F.struct("list", "rows", "least")).alias("held"))
    asked = questions.select(F.col(L).cast("int"), F.col("question_id").cast("bigint"), F.col("query_vector").cast("array<double>")).join(table, L)
    return asked.mapInArrow(run, f"{L} int, question_id bigint, unit array<double>, first array<int>, rest array<struct<list:int,bound:double>>")


def _parts(n: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / CELL), F.lit(1)).cast("int")


def _met(asked: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """``ledger, question_id, answer_id, similarity``: the ``k`` best of each cell.  ``asked``: ledger, question_id, unit, list."""
    keys = [L, "list"]
    sizes = asked.groupBy(*keys).agg(F.count("*").alias("asked")).join(index.lists.select(*keys, "rows"), keys).select(
        *keys, _parts("asked").alias("across"), _parts("rows").alias("down"))
    left = asked.join(sizes, keys).withColumn("column", F.pmod(F.xxhash64("question_id"), F.col("across")).cast("int")).withColumn(
        "row", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).select(*keys, "column", "row", "question_id", "unit")
    right = index.rows.join(sizes, keys).withColumn("row", F.pmod(F.xxhash64("answer_id"), F.col("down")).cast("int")).withColumn(
        "column", F.explode(F.sequence(F.lit(0), F.col("across") - 1))).select(*keys, "column", "row", "answer_id", "unit")

    def flat(table: pa.Table) -> np.ndarray:
        column = table.column("unit").combine_chunks()
        return column.flatten().to_numpy().reshape(len(table), -1)

    def run(questions: pa.Table, answers: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(questions) and len(answers):
            answers = answers.sort_by("answer_id")
            held, names = flat(answers), answers.column("answer_id").to_numpy()
            asked_units, asked_names = flat(questions), questions.column("question_id").to_numpy()
            step = max(1, 4_000_000 // len(names))
            for start in range(0, len(asked_names), step):
                score = np.round(asked_units[start:start + step] @ held.T, 6)
                edge = np.partition(score, -k, axis=1)[:, -k] if len(names) > k else np.full(len(score), -2.0)
                who, which = np.nonzero(score >= edge[:, None])
                value = score[who, which]
                order = np.lexsort((which, -value, who))
                who, which, value = who[order], which[order], value[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                keep = place < k
                found.append((asked_names[start + who[keep]], names[which[keep]], value[keep]))
        ids, answers_, values = (np.concatenate([f[i] for f in found]) if found else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, float)))
        ledger = questions.column(L)[0].as_py() if len(questions) else 0
        return pa.table({L: pa.array(np.full(len(ids), ledger, np.int32)), "question_id": ids, "answer_id": answers_, "similarity": values})

    cell = [*keys, "column", "row"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, f"{L} int, question_id bigint, answer_id bigint, similarity double")


def search(questions: DataFrame, index: VectorIndex, k: int = 5, min_similarity: float = 0.5, exact: bool = True,
           probed: float = PROBED) -> DataFrame:
    """``ledger_id, question_id, answer_id, similarity``: the ``k`` nearest rows of the question's ledger, at least ``min_similarity``.

    ``questions``: ledger_id, question_id (unique within the ledger), query_vector.  Equal similarities, rounded to six digits, go by
    answer_id.  A question probes the nearest ``probed`` share of its ledger's lists, and as many as hold ``k`` rows; ``exact``
    reads every further list that can still change the result.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    order = [F.col("similarity").desc(), F.col("answer_id")]
    plan = _planned(questions, index, k, probed, min_similarity)
    near = _met(plan.select(L, "question_id", "unit", F.explode("first").alias("list")), index, k)
    near = top_per(near, [L, "question_id"], order, k)
    if exact:
        settled = near.groupBy(L, "question_id").agg(F.count("*").alias("hits"), F.min("similarity").alias("last"))
        open_ = plan.join(settled, [L, "question_id"], "left").withColumn(
            "need", F.when(F.col("hits") == k, F.greatest("last", F.lit(min_similarity))).otherwise(F.lit(min_similarity)) - SLACK)
        rest = open_.withColumn("more", F.explode("rest")).filter("more.bound >= need").select(L, "question_id", "unit", "more.list")
        near = top_per(near.unionByName(_met(rest, index, k)), [L, "question_id"], order, k)
    return near.filter(F.col("similarity") >= min_similarity)
