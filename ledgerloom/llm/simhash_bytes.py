"""SimHash near-duplicates through an index of composite byte positions.

Fingerprints of 64 bits that differ in at most three bits differ in at most
three of their eight bytes, so they share five positional bytes or more.  The
index therefore posts a fingerprint under each choice of five byte positions
(56 postings of 40 bits): only pairs that reach the guaranteed count ever meet.
A tally of shared positional bytes thus filters nothing more; the Hamming distance
is verified.

Equal fingerprints are one index entry, so copies never pair up.  A posting
holds at most 2^24 entries, since five of eight bytes are fixed.  Postings of
more than ``PAIR_LIMIT`` entries emit no pairs: entries equal outside some three
of the 24 free bits are all within three bits of each other, so each such set
links its members to its smallest, which gives the same components from a
number of rows linear in the posting.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, order_id, real_id
from .components import components

MAX_DISTANCE = 3
KEPT = list(combinations(range(8), 8 - MAX_DISTANCE))
FREE = [[p for p in range(8) if p not in kept] for kept in KEPT]
PAIR_LIMIT = 256
#: Share of all rows from which the rows of a fingerprint are not shuffled; results do not depend on it.
HOT_SHARE = 1e-4


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


MASKS = [_signed(sum(0xFF << 8 * p for p in kept)) for kept in KEPT]


def simhash(text: bytes, shingle: int = 3) -> int:
    """Majority bits of XXH64 (seed 42) over word shingles, A-Z lower-cased; 0 without words; signed."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([digest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | Column, shingle: int = 3) -> Column:
    """The SimHash of a text column as a signed long; a missing text counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        return pa.array([simhash(x.as_py() or b"", shingle) for x in raw], pa.int64())

    return F.arrow_udf(run, T.LongType())(F.col(text) if isinstance(text, str) else text)


def _shared(a: str, b: str) -> Column:
    diff = F.col(a).bitwiseXOR(F.col(b))
    return sum((F.when(diff.bitwiseAND(F.lit(_signed(0xFF << 8 * p))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links that span every pair of distinct ``fp`` within three bits (pairs, or a smallest member)."""
    posts = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS])).alias("pos", "post"))
    held = cut(posts.withColumn("n", F.count("*").over(Window.partitionBy("pos", "post"))).filter("n > 1"), "posts")
    few = held.filter(F.col("n") <= PAIR_LIMIT)
    pairs = (few.select("pos", "post", F.col("fp").alias("a"))
             .join(few.select("pos", "post", F.col("fp").alias("b")), ["pos", "post"]).filter("a < b")
             .filter(_shared("a", "b") >= 8 - MAX_DISTANCE)
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE).select("a", "b").distinct())
    many = held.filter(F.col("n") > PAIR_LIMIT)
    shifts = [F.element_at(F.array(*[F.lit(8 * f[i]) for f in FREE]), F.col("pos") + 1) for i in range(MAX_DISTANCE)]
    byte = [F.expr("fp").bitwiseAND(F.lit(-1)) for _ in shifts]
    free = sum((F.call_function("shiftleft", F.call_function("shiftrightunsigned", x, s).bitwiseAND(F.lit(0xFF)), F.lit(8 * i))
                for i, (x, s) in enumerate(zip(byte, shifts, strict=True))), F.lit(0))
    holes = F.lit([(1 << 24) - 1 - sum(1 << i for i in c) for c in combinations(range(24), MAX_DISTANCE)])
    sets = (many.select("pos", "post", "fp", free.alias("free"), F.posexplode(holes).alias("hole", "mask"))
            .withColumn("same", F.col("free").bitwiseAND(F.col("mask").cast("long"))))
    keys = ["pos", "post", "hole", "same"]
    least = sets.groupBy(*keys).agg(F.min("fp").alias("a"), F.count("*").alias("k")).filter("k > 1").drop("k")
    stars = sets.join(least, keys).filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars).distinct()


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, row_hash, fp`` of every row, written once."""
    return cut(docs.select(order_id(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("row_hash"), fingerprint(text).alias("fp")), "simhash")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, row_hash, fp, group``: rows with the smallest fingerprint their own one links to.  Ids play no part in it."""
    rows = _rows(docs, doc_id, text)
    prints = cut(rows.select("fp").distinct(), "prints")
    found = components(links(prints)).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    return cut(rows.join(found, "fp", "left").withColumn("group", F.coalesce("group", "fp")), "groups")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row_hash, fp, component_id``: one row per document row.

    Fingerprints link at three or fewer differing bits; ``component_id`` is the smallest doc_id reachable by these links alone: rows
    that share an id, or have none, are not linked by it.  A missing or blank text has fingerprint 0 and links like any other; a
    missing doc_id comes last and names a component only where no document has an id.  An empty table gives none.
    """
    rows = _rows(docs, doc_id, text)
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "prints")
    found = components(links(prints.select("fp"))).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    named = prints.join(found, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    named = cut(named.join(named.groupBy("group").agg(F.min("least").alias("component")), "group").select("fp", "n", "component"), "named")
    often = F.col("n") >= F.lit(HOT_SHARE) * (prints.agg(F.sum("n")).first()[0] or 0)
    hot = F.broadcast(named.filter(often).drop("n"))  # at most 1 / HOT_SHARE
    rare = rows.join(hot.select("fp"), "fp", "left_anti").join(named.filter(~often).drop("n"), "fp")
    rows = rows.join(hot, "fp").unionByName(rare)
    return rows.select(real_id("id").alias("doc_id"), "row_hash", "fp", real_id("component").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of linked fingerprints: the one of smallest doc_id; of repeated rows, one."""
    stay = _grouped(docs, doc_id, text).groupBy("group").agg(F.min(F.struct("id", "row_hash")).alias("least"))
    stay = stay.select(F.col("least.id").alias("__id"), F.col("least.row_hash").alias("__hash"))
    keyed = docs.withColumns({"__id": order_id(doc_id), "__hash": F.xxhash64(F.col(text))})
    return keyed.join(stay, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
