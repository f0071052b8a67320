"""The quality model counts every trusted document, and its threshold is an exact quantile of all their scores."""

import random
from math import log

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality_llr as Q


def test_all_trusted_rows_are_counted(spark):
    # more trusted documents than the 10,000 that were once sampled; the last word of each is its own
    n = 12_000
    docs = spark.range(n + 500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < n).cast("int").alias("quality"))
    model = Q.fit(docs, labels)
    held = {r.w: (r.bucket, r.raw, r.trusted) for r in docs.groupBy(F.col("text").alias("w")).agg(
        F.first(F.pmod(F.xxhash64("text"), F.lit(Q.BUCKETS)).cast("int")).alias("bucket"), F.count("*").alias("raw"),
        F.count_if(F.col("doc_id") < n).alias("trusted")).collect()}
    norm = log((n + 500 + Q.BUCKETS) / (n + Q.BUCKETS))
    assert len({b for b, _, _ in held.values()}) == 7
    for bucket, raw, trusted in held.values():
        assert model.ratios[bucket] == pytest.approx(log((trusted + 1) / (raw + 1)) + norm)


@pytest.mark.parametrize("n, share", [(0, 0.1), (1, 0.3), (2, 0.002), (5, 0.5), (30_000, 0.002), (30_000, 0.0), (30_000, 1.0)])
def test_quantile_is_exact(spark, n, share):
    rng = random.Random(n)
    values = spark.createDataFrame([(rng.choice([rng.random(), 0.25, None]),) for _ in range(n)], "s double").repartition(4).cache()
    assert Q.quantile(values, "s", share) == values.agg(F.percentile("s", F.lit(share))).first()[0]


def test_texts_stay_where_they_are_read(spark, monkeypatch):
    # trusted ids that no broadcast threshold lets through must not bring the texts into a shuffle
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    taken = []
    monkeypatch.setattr(Q, "hashed", lambda rows, text="text", run=Q.hashed: taken.append(rows) or run(rows, text))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        Q.fit(docs, labels)
        plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in taken]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in p or "SortMergeJoin" in p for p in plans)
    assert taken[1].count() == 1_500
