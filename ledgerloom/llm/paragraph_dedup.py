"""Repeated paragraphs: MinHash banding, exact Jaccard, components.

A paragraph is a line of one word or more.  Equal paragraphs are one text from the
start.  One of fewer than ``SHINGLE`` words has its whole word sequence as its only
shingle, so it resembles its equals alone and needs no banding.  Each longer text gets ``BANDS`` keys of ``ROWS`` least hashes over
its five-word shingles: at a similarity of 0.8 a pair shares a key with a
probability of 99.8 %.  Texts that share a key are joined; a bound on the size of
their difference, from 128 parity bits each, leaves out most unlike pairs and no
other; of the rest the exact Jaccard similarity is computed, and linked texts form components.  Of a component the
first paragraph, by document id and place, stays.

Keys with up to ``FEW`` texts join all of them.  In a larger one every text first
meets one text, the key's pivot, and leaves the key where it provably has no
link there (see ``_open``).  The rest is worked off by
rounds: the first texts of a key meet those of its other texts that are not yet
in their component, twice as many first texts each round, until all texts of
the key are in one component or have met.  A large group of near-copies is one
component after the pivot has met them, so its pairs are never spelled out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, order_id, real_id, word_array
from .components import components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 9, 3
FEW = 32
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def band_keys(text: Column) -> Column:
    """``BANDS`` keys of each text of at least SHINGLE words; vectorised over the rows of an Arrow batch."""

    def run(texts: pa.Array) -> pa.Array:
        hashes, ends, digest = [], [], xxhash.xxh64_intdigest
        for x in texts:
            w = x.as_py().lower().encode("utf-8", "replace").split()
            hashes += [digest(b" ".join(w[i:i + SHINGLE])) for i in range(max(1, len(w) - SHINGLE + 1))]
            ends.append(len(hashes))
        if not ends:
            return pa.array([], pa.list_(pa.int64()))
        shingles, starts = np.array(hashes, dtype=np.uint64), np.append(0, ends[:-1])
        least = [np.minimum.reduceat(m := (shingles * a + b) ^ ((shingles * a + b) >> np.uint64(29)), starts) for a, b in zip(_MULTIPLY, _ADD, strict=True)]
        keys = [sum((least[i * ROWS + j] * np.uint64(0x9E3779B97F4A7C15 + 2 * j) for j in range(ROWS)), np.uint64(i)) for i in range(BANDS)]
        return pa.FixedSizeListArray.from_arrays(pa.array(np.stack(keys, axis=1).ravel().astype(np.int64)), BANDS).cast(pa.list_(pa.int64()))

    return F.arrow_udf(run, T.ArrayType(T.LongType()))(text)


def shingle_set(words: str) -> Column:
    """Distinct hashes of all runs of SHINGLE words.  ``words`` names a column: an expression would be evaluated anew for every run."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))


def _parity(shingles: str, half: int) -> Column:
    """64 bits: bit i is the parity of the shingles whose hash ends in ``half`` and i.  Bits that differ are at most the shingles that do."""
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda bits, h: F.when(
        F.shiftright(h, 6).bitwiseAND(F.lit(1)) == half, bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))).otherwise(bits))


def _set_table(texts: DataFrame) -> DataFrame:
    """``para, shingles, size, p0, p1`` of ``para, text``."""
    sets = texts.select("para", word_array(F.lower("text")).alias("words")).select("para", shingle_set("words").alias("shingles"))
    return sets.withColumns({"size": F.size("shingles"), "p0": _parity("shingles", 0), "p1": _parity("shingles", 1)})


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with a Jaccard similarity of LEAST or more.

    Such a pair differs in at most (1 - LEAST) / (1 + LEAST) of both sizes; sizes and parity bits tell most others before a set is moved.
    """
    for k in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("para").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("size", "p0", "p1"))), k)
    differ = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in ("p0", "p1")), F.lit(0))
    most = (F.col("a_size") + F.col("b_size")) * ((1 - LEAST) / (1 + LEAST)) + 1e-6
    near = pairs.filter((F.abs(F.col("a_size") - F.col("b_size")) <= most) & (differ <= most)).select("a", "b")
    for k in ("a", "b"):
        near = near.join(sets.select(F.col("para").alias(k), F.col("shingles").alias(f"{k}_set")), k)
    common = F.size(F.array_intersect("a_set", "b_set"))
    return near.filter(common >= LEAST * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")


def _open(many: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``band, key, para`` of the texts of large keys that may still have a link there, and the links ``a, b`` to pivots.

    A text's own shingles are those of no other text of a large key.  The pivot of a key is the text with the fewest own ones.
    Let x and y be texts of a key that share no shingle outside the pivot p; as all of x outside p is its own, that is so for every y.
    Then they share at most min(|x & p|, |y & p|), and a likeness of LEAST asks for LEAST / (1 + LEAST) of |x| + |y|.  If no y of
    the key is of a size and a share of p that allow it, x has no link in this key.  No text is left out by anything but this bound,
    and by the same bound without p: a text with more than 1 - LEAST of own shingles has no link at all.
    """
    ratio = LEAST / (1 + LEAST)
    held = cut(sets.join(many.select("para").distinct(), "para").select("para", "shingles", "size"), "large")
    single = held.select("para", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("para").alias("para"), F.count("*").alias("n")).filter("n = 1")
    own = cut(held.drop("shingles").join(single.groupBy("para").agg(F.count("*").alias("own")), "para", "left").withColumn("own", F.coalesce("own", F.lit(0))), "own")
    likely = many.select("band", "key", "para").join(own.filter(F.col("size") - F.col("own") >= LEAST * F.col("size") - 1e-6), "para")
    pivots = likely.groupBy("band", "key").agg(F.max(F.struct(-F.col("own"), "size", "para")).alias("pivot")).select("band", "key", F.col("pivot.para").alias("pivot"), F.col("pivot.size").alias("p_size"))
    members = cut(likely.join(pivots, ["band", "key"]), "members")
    pairs = members.select("para", "pivot").distinct()
    for k in ("para", "pivot"):
        pairs = pairs.join(held.select(F.col("para").alias(k), F.col("shingles").alias(f"{k}_set")), k)
    shared = pairs.select("para", "pivot", F.size(F.array_intersect("para_set", "pivot_set")).alias("shared"))
    members = cut(members.join(shared, ["para", "pivot"]), "shared")
    best = members.groupBy("band", "key", F.col("size").alias("other")).agg(F.max("shared").alias("most")).groupBy("band", "key").agg(F.collect_list(F.struct("other", "most")).alias("sizes"))
    need = ratio * (F.col("size") + F.col("p_size")) - 1e-6
    may = F.exists("sizes", lambda o: F.least(F.col("shared"), o["most"]) >= ratio * (F.col("size") + o["other"]) - 1e-6)
    kept = members.join(best, ["band", "key"]).filter((F.col("shared") + F.col("own") < F.col("size")) | may)
    linked = members.filter((F.col("para") != F.col("pivot")) & (F.col("shared") >= need)).select(F.least("para", "pivot").alias("a"), F.greatest("para", "pivot").alias("b"))
    return kept.select("band", "key", "para"), linked.distinct()


def links(texts: DataFrame) -> DataFrame:
    """``a, b``: links of ``texts`` (para, text) that give the components of all pairs with a common key and LEAST similarity."""
    posts = texts.select("para", F.posexplode(band_keys(F.col("text"))).alias("band", "key"))
    held = cut(posts.withColumn("n", F.count("*").over(Window.partitionBy("band", "key"))).filter("n > 1"), "bands")
    sets = cut(_set_table(texts.join(held.select("para").distinct(), "para")), "sets")
    few = held.filter(F.col("n") <= FEW)
    pairs = (few.select("band", "key", F.col("para").alias("a")).join(few.select("band", "key", F.col("para").alias("b")), ["band", "key"])
             .filter("a < b").select("a", "b").distinct())
    found = cut(_alike(pairs, sets), "alike")
    rest, near = _open(held.filter(F.col("n") > FEW), sets)
    found = cut(found.union(near), "alike")
    of_key = Window.partitionBy("band", "key")
    many = cut(rest.withColumns({"rank": F.row_number().over(of_key.orderBy("para")), "n": F.count("*").over(of_key)}).filter("n > 1"), "many")
    most, done, step = many.agg(F.max("n")).first()[0] or 0, 0, 4
    while done < most:
        named = components(found)
        here = many.join(named.withColumnRenamed("node", "para"), "para", "left").withColumn("component", F.coalesce("component", "para"))
        first = here.filter((F.col("rank") > done) & (F.col("rank") <= done + step)).select("band", "key", F.col("para").alias("a"), F.col("rank").alias("r"), F.col("component").alias("c"))
        met = (here.select("band", "key", F.col("para").alias("b"), "rank", "component").join(first, ["band", "key"])
               .filter("rank > r AND component <> c").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = cut(found.union(_alike(met, sets)), "alike")
        done, step = done + step, 2 * step
    return found


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, n_removed, removed, class_ids, class_id``: one row per distinct row of ``docs``.

    ``removed`` lists the places (lines, from 0) to remove; ``class_ids`` the classes, named by their smallest doc_id, of the
    document's paragraphs that repeat anywhere; ``class_id`` is the least of these, or the document itself.  A missing text
    has no paragraphs, a missing id counts as the largest; a repeated row is one document.  An empty table gives none.
    """
    own = docs.select(F.xxhash64(order_id(doc_id), F.col(text)).alias("row"), order_id(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = own.select("row", "id", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("size", F.size(word_array("line"))).filter("size > 0")
    lines = lines.withColumn("para", F.xxhash64(F.array_join(word_array(F.lower("line")), " ")))
    places = cut(lines.select("row", "id", "place", "para").distinct(), "places")
    counts = cut(places.groupBy("para").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "place")).alias("first")), "paragraphs")
    texts = cut(lines.filter(F.col("size") >= SHINGLE).groupBy("para").agg(F.min("line").alias("text")), "texts")
    named = components(links(texts))
    grouped = counts.join(named.withColumnRenamed("node", "para"), "para", "left").withColumn("component", F.coalesce("component", "para"))
    heads = grouped.groupBy("component").agg(F.sum("n").alias("n"), F.min("first").alias("head")).filter("n > 1")
    repeated = grouped.select("para", "component").join(heads, "component").select("para", "head")
    hit = places.join(repeated, "para").select(
        "row", "place", F.col("head.id").alias("class"), (F.struct("id", "row", "place") != F.col("head")).alias("gone"))
    per_doc = hit.groupBy("row").agg(F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("place")))).alias("removed"),
                                     F.array_sort(F.collect_set(real_id("class"))).alias("class_ids"))
    all_docs = own.select("row", "id").distinct()
    sizes = places.groupBy("row").agg(F.count("*").alias("n_paragraphs"))
    out = all_docs.join(sizes, "row", "left").join(per_doc, "row", "left")
    return out.select(real_id("id").alias("doc_id"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
                      F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
                      F.coalesce("class_ids", F.array().cast("array<bigint>")).alias("class_ids"),
                      F.coalesce(F.array_min("class_ids"), real_id("id")).alias("class_id"))


def rewrite(text: str | Column, removed: str | Column) -> Column:
    """The text without the lines at the removed places."""
    text, removed = (F.col(c) if isinstance(c, str) else c for c in (text, removed))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.array_join(F.transform(F.filter(lines, lambda s: ~F.array_contains(removed, s["i"])), lambda s: s["x"]), "\n")
