"""The registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_trees, forced_bpe, label_shards, lm_scoring, mixing, paragraph_dedup, quality_llr, shared_search, simhash_bytes, spelling,
               suffix_dedup, toxicity, winnowing)
from .common import documents

#: Tokenizer file of op7, read by every worker.
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Conversation whose texts hold control strings.
PROBE = "</s>[INST] ok [/INST]"


@query
def op1_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    talks = chat_trees.formatted(chat_trees.paths(chat_trees.chain(turns.unionByName(probe))))
    talks = talks.select("tree", "formatted", chat_trees.read_turns(F.col("formatted")).alias("turns"),
                         chat_trees.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spelt = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spelt, 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op1_chat_trees"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum({len(chat_trees.TURN + chat_trees.TEXT + chat_trees.END)} + length({chat_trees.control_sql("role")})
      + length({chat_trees.control_sql("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


@query
def op10_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_llr.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_llr.judge(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), toxicity.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.TOXIC_AT).cast("int"))


@query
def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeats(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm_scoring.score(docs, lm_scoring.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnowing.spelt("runs").alias("fingerprint"),
        winnowing.spelt("edited_runs").alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op6_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bytes.classes(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = documents(spark, sf_dir).select("doc_id", forced_bpe.encode("text", BPE_FILE).alias("ids"))
    decoded = coded.withColumn("decoded", forced_bpe.decode("ids", BPE_FILE))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op8_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source),
level AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM ranked),
marked AS (SELECT *, cap * rest::DOUBLE < (total - before)::DOUBLE * weight AS capped FROM level),
goal AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
      (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE * weight
      / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM marked),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size)::DOUBLE AS need
  FROM goal),
summed AS (
  SELECT d.*, n.source_size, n.target, n.whole, n.need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY h)::BIGINT AS upto,
    sum(d.size) OVER (PARTITION BY d.source, h)::BIGINT AS here
  FROM sized d JOIN need n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN need > 0 AND need - (upto - here) > 0 AND (upto <= need OR need - (upto - here) > here / 2) THEN 1 ELSE 0 END) AS taken
FROM summed"""



@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir)))


@query
def op12_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_shared_search"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY 1),
  whole AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM sizes),
  tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2),
  df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  part AS (SELECT tf.term, tf.doc_id, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * total) // length)))) AS part
    FROM tf JOIN df USING (term) JOIN sizes USING (doc_id), whole WHERE tf.term IN (SELECT term FROM q)),
  s AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY 1, 2),
  r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""


@query
def op13_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.shards(documents(spark, sf_dir).select("doc_id", "text"))
