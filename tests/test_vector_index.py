"""The vector index: equal to a full search with completion, measured recall without, hot lists, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import vector_index as V

COLUMNS = "ledger_id int, answer_id bigint, embedding array<float>, verdict string"


def frame(spark, vectors, ledgers, rejected=()):
    return spark.createDataFrame([(int(g), i, None if v is None else [float(x) for x in v], "REJECTED" if i in rejected else "NORMAL")
                                  for i, (v, g) in enumerate(zip(vectors, ledgers))], COLUMNS)


def brute(vectors, ledgers, k, least, rejected=()):
    x = np.array(vectors, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for q in range(len(x)):
        held = [i for i in range(len(x)) if ledgers[i] == ledgers[q] and i not in rejected]
        score = np.round(x[held] @ x[q], 6)
        best = sorted(zip(-score, held))[:k]
        out |= {(q, i, -s) for s, i in best if -s >= least}
    return out


def asked(df):
    return df.select("ledger_id", F.col("answer_id").alias("question_id"), F.col("embedding").alias("query_vector"), F.lit(1).alias("rows"))


def got(df):
    return {(r.question_id, r.answer_id, r.similarity) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    heads = rng.normal(size=(30, 16))
    return heads[rng.integers(0, 30, 1500)] + 0.35 * rng.normal(size=(1500, 16)), rng.choice([1, 1, 1, 2, 3], 1500)


@pytest.mark.parametrize("k, least", [(5, 0.1), (3, 0.9), (2000, -1.0)])
def test_equal_to_a_full_search(spark, tmp_path, clustered, k, least, monkeypatch):
    monkeypatch.setattr(V, "CELL", 20)  # every list of more than 20 rows becomes a grid
    vectors, ledgers = clustered
    rejected = set(range(0, 1500, 7))
    if k > 1000:
        vectors, ledgers = vectors[:150], ledgers[:150]
    df = frame(spark, vectors, ledgers, rejected)
    index = V.build(df, str(tmp_path / "index"))
    assert index.rows.select("list").distinct().count() > 3
    assert got(V.search(asked(df), index, k, least)) == brute(vectors, ledgers, k, least, rejected)


def test_recall_of_the_probes_alone(spark, tmp_path, clustered):
    vectors, ledgers = clustered
    df = frame(spark, vectors, ledgers)
    V.build(df, str(tmp_path / "index"))
    index = V.load(spark, str(tmp_path / "index"))
    want = {x[:2] for x in brute(vectors, ledgers, 5, -1.0)}
    found = {x[:2] for x in got(V.search(asked(df), index, 5, -1.0, exact=False))}
    assert len(found & want) / len(want) >= 0.9


def test_a_third_of_all_rows_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "CELL", 64)
    rng = np.random.default_rng(3)
    vectors = np.concatenate([np.ones((300, 8)), rng.normal(size=(600, 8))])
    ledgers = [1] * 900
    df = frame(spark, vectors, ledgers)
    index = V.build(df, str(tmp_path / "index"))
    assert got(V.search(asked(df), index, 4, 0.2)) == brute(vectors, ledgers, 4, 0.2)


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    vectors = [[1, 0, 0], [0, 0, 0], None, [1, 2], [float("nan"), 1, 1], [0.9, 0.1, 0], []]
    df = frame(spark, vectors, [1] * 7)
    index = V.build(df, str(tmp_path / "index"))
    hits = got(V.search(asked(df), index, 5, 0.5))
    assert {x[:2] for x in hits} == {(0, 0), (0, 5), (5, 5), (5, 0)}
    assert V.search(asked(df).limit(0), index, 5).count() == 0
    assert V.search(asked(df).withColumn("ledger_id", F.lit(9)), index, 5).count() == 0
    nothing = V.build(df.limit(0), str(tmp_path / "none"))
    assert V.search(asked(df), nothing, 5).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        V.search(asked(df), index, 0)


def test_no_join_on_the_ledger_alone(spark, tmp_path, clustered):
    df = frame(spark, *clustered)
    index = V.build(df, str(tmp_path / "index"))
    plan = V.search(asked(df), index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "FlatMapCoGroupsInArrow" in plan
