"""A text index beside the ledger: a search reads only the blocks that can hold its text.

Rows are written in blocks of about ``block_rows``, ordered by ledger, account and party, so rows that say the same lie
together; a block is one folder.  Every block posts the trigrams of its searched columns, once each.  Postings lie in slices by
trigram, so a text of n letters reads at most n - 2 slices.  A block is a candidate if it posts all trigrams of the text; its rows
are then tested like those of a scan, so the answer is the scan's.  Candidate blocks meet the rows by their folder, which prunes
the read at run time.

Rows that come later are appended as blocks of their own.  The list of blocks is written last: a block that is not on it is not
seen, so a build that dies half-way leaves only files nobody reads.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import low
from .schema_intel import SEARCHED, gl_search

L = "ledger_id"
GRAM = 3
SLICES = 64
BLOCK_ROWS = 1_000_000
BATCH, BLOCK, SLICE = "text_batch", "text_block", "slice"


def trigrams(text: Column) -> Column:
    """All runs of three letters of a text, in order; none for a shorter one."""
    n = F.length(text) - (GRAM - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def _slice(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLICES)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """``rows`` (the ledger, by batch and block), ``postings`` (gram, batch, block, by slice) and ``blocks`` (batch, block, rows)."""

    spark: SparkSession
    path: str
    schema: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {BATCH} string, {BLOCK} int").parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"gram string, {BATCH} string, {BLOCK} int, {SLICE} int").parquet(f"{self.path}/postings")

    def blocks(self) -> DataFrame:
        """One row a block: a bounded part of the ledger's size, 1 / block_rows."""
        return self.spark.read.schema(f"{BATCH} string, {BLOCK} int, n bigint").parquet(f"{self.path}/blocks")

    def candidates(self, text: str) -> DataFrame:
        """``text_batch, text_block``: blocks that post every trigram of the lower-cased text; all, if it has fewer than three letters."""
        lowered = text.lower()
        asked = sorted({lowered[i:i + GRAM] for i in range(len(lowered) - GRAM + 1)})
        if not asked:
            return self.blocks().select(BATCH, BLOCK)
        table = self.spark.createDataFrame([(g,) for g in asked], "gram string").select("gram", _slice(F.col("gram")).alias(SLICE))
        slices = [r[SLICE] for r in table.select(SLICE).distinct().collect()]
        met = self.postings().filter(F.col(SLICE).isin(slices) & F.col("gram").isin(asked))
        full = met.groupBy(BATCH, BLOCK).agg(F.count_distinct("gram").alias("grams")).filter(F.col("grams") == len(asked))
        return full.join(self.blocks(), [BATCH, BLOCK], "left_semi").select(BATCH, BLOCK)

    def search(self, text: str, **filters) -> DataFrame:
        """``gl_search`` of the ledger for ``text``, with its other filters, from the candidate blocks alone."""
        kept = self.rows().join(F.broadcast(self.candidates(text)), [BATCH, BLOCK], "left_semi")
        return gl_search(kept.drop(BATCH, BLOCK), text, **filters)


def _schema(gl: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gl.schema.fields)


def append(gl: DataFrame, index: TextIndex, block_rows: int = BLOCK_ROWS) -> TextIndex:
    """Index the rows of ``gl`` as blocks of their own.  An empty ledger adds none."""
    n, batch = gl.count(), uuid4().hex
    parts = max(1, -(-n // block_rows))
    # the row id ends the order, so an account with a third of all rows is cut like any other
    dealt = gl.repartitionByRange(parts, L, "account_name", "party_name", "row_id").withColumns({BATCH: F.lit(batch), BLOCK: F.spark_partition_id()})
    dealt.write.mode("append").option("compression", "zstd").partitionBy(BATCH, BLOCK).parquet(f"{index.path}/rows")
    held = index.rows().filter(F.col(BATCH) == batch)
    values = held.select(BATCH, BLOCK, F.explode(F.array_distinct(F.array(*[low(c) for c in SEARCHED]))).alias("value")).distinct()
    posted = values.select(BATCH, BLOCK, F.explode(F.array_distinct(trigrams(F.col("value")))).alias("gram")).distinct()
    posted = posted.withColumn(SLICE, _slice(F.col("gram"))).repartition(SLICES, SLICE).sortWithinPartitions(SLICE, "gram")
    posted.select("gram", BATCH, BLOCK, SLICE).write.mode("append").partitionBy(SLICE).parquet(f"{index.path}/postings")
    held.groupBy(BATCH, BLOCK).agg(F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{index.path}/blocks")
    return index


def load(spark: SparkSession, path: str, gl: DataFrame) -> TextIndex:
    """The index written below ``path``; ``gl`` gives the columns of its rows."""
    return TextIndex(spark, path.rstrip("/"), _schema(gl))


def build(gl: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> TextIndex:
    """A new index of ``gl`` below ``path``."""
    return append(gl, load(gl.sparkSession, path, gl), block_rows)
