"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import forced_bpe, mixing, simhash_bytes, suffix_dedup, toxicity
from ledgerloom.llm.common import cut, documents
from ledgerloom.llm.queries import BPE_FILE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score("text", model) < toxicity.TOXIC_AT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one of smallest doc_id."""
    return simhash_bytes.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that a document of smaller doc_id has too."""
    return suffix_dedup.rewrite(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times."""
    return mixing.repeat(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text they came from."""
    coded = docs.select("doc_id", "source", forced_bpe.round_trip("text", BPE_FILE).alias("coded"))
    return coded.select("doc_id", "source", "coded.ids", F.size("coded.ids").cast("long").alias("n_tokens"),
                        F.col("coded.same").alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]
#: No SQL: a trained classifier, SimHash components and BPE merges are beyond it.  The tests compare with brute force.
ORACLE_SQL = None


#: Rows of whole texts that travel to a worker at a time; results do not depend on it.
BATCH_ROWS = 1_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
