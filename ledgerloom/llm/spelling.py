"""Spelling variants: exact neighbours at one edit through a dictionary of trie-node pairs.

The prefixes of all words are the nodes of a forward trie, their suffixes the
nodes of a reversed one; both are numbered.  A word split at position i is the
integer pair (node of its first i code points, node of the rest).  Skipping the
code point at i gives the pair (node before i, node after i).  Two words differ
by one replaced code point where their skipped pairs are equal, and by one
inserted code point where a skipped pair of the longer equals a split pair of
the shorter.

A split pair names one word, and a skipped pair as many as the alphabet has
letters, so no key is hot and the joins make the links themselves, nothing more.
In a run of equal letters only the last is skipped when a letter is dropped:
each link is met once and needs no ``distinct``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Least code points and least occurrences of a word.
LETTERS, SEEN = 5, 3
#: One run in so many loses a code point.
EVERY = 97
#: A form is at least so many times as frequent as its variant.
TIMES = 2
#: Distinct words a counting task holds before it hands them on.
HELD = 500_000

RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task's texts, in parts of bounded size."""
    held: Counter[str] = Counter()

    def part() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            start = crc32(key + b":")
            # bytes.lower() changes A-Z alone
            for word, n in Counter(RUN.findall((raw.as_py() or b"").lower().decode("utf-8", "replace"))).items():
                h = crc32(word.encode(), start)
                if h % EVERY == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                    if len(word) < LETTERS:
                        continue
                held[word] += n
            if len(held) > HELD:
                yield part()
    yield part()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seen: int = SEEN) -> DataFrame:
    """``word, n``: the words of all texts with at least ``seen`` occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; where ``EVERY`` divides the CRC-32 ``h`` of
    ``<doc_id>:<run>``, the run's code point ``h % length`` is left out.  Runs and results of fewer than ``LETTERS`` code points do
    not count.  A missing text has no words, a missing doc_id is spelt as nothing; repeated rows count each; an empty table gives none.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    parts = docs.select(key.alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(_count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)


def _nodes(strings: DataFrame, name: str) -> DataFrame:
    """``part, node``: the distinct strings with a number each; stored, so that the numbers last."""
    return cut(strings.distinct().withColumn("node", F.monotonically_increasing_id()), name)


def _splits(words: DataFrame) -> DataFrame:
    """``id, n, place, head, tail, turn``: every word cut at each place; ``turn``: the letter after the place ends a run of its like."""
    word, at = F.col("word"), F.col("place")
    letter = F.substring(word, at + 1, F.lit(1))
    return words.withColumn("place", F.explode(F.sequence(F.lit(0), F.length(word)))).select(
        "id", "n", "place", F.substring(word, F.lit(1), at).alias("head"), F.substring(word, at + 1, F.length(word)).alias("tail"),
        (letter != F.substring(word, at + 2, F.lit(1))).alias("turn"))


def neighbours(words: DataFrame) -> DataFrame:
    """``id, n, other, other_n``: each link between two words one edit apart, in both directions.  ``words``: ``id, word, n``, distinct."""
    cuts = cut(_splits(words), "splits")
    heads = _nodes(cuts.select(F.col("head").alias("part")), "forward-trie")
    tails = _nodes(cuts.select(F.col("tail").alias("part")), "reversed-trie")
    numbered = (cuts.join(heads.select(F.col("part").alias("head"), F.col("node").alias("p")), "head")
                .join(tails.select(F.col("part").alias("tail"), F.col("node").alias("s")), "tail").select("id", "n", "place", "turn", "p", "s"))
    after = F.lead("s").over(Window.partitionBy("id").orderBy("place"))
    pairs = cut(numbered.withColumn("after", after), "node-pairs")
    whole = pairs.select("p", "s", F.col("id").alias("other"), F.col("n").alias("other_n"))
    skipped = pairs.filter("after IS NOT NULL").select("p", F.col("after").alias("s"), "id", "n", "turn")
    replaced = skipped.drop("turn").join(
        skipped.select("p", "s", F.col("id").alias("other"), F.col("n").alias("other_n")), ["p", "s"]).filter("id <> other")
    dropped = skipped.filter("turn").drop("turn").join(whole, ["p", "s"])
    columns = ["id", "n", "other", "other_n"]
    dropped = dropped.select(F.explode(F.array(
        F.struct(*columns), F.struct(F.col("other").alias("id"), F.col("other_n").alias("n"), F.col("id").alias("other"),
                                     F.col("n").alias("other_n")))).alias("link")).select("link.*")
    return replaced.select(*columns).union(dropped)


def _roots(ups: DataFrame) -> DataFrame:
    """``id, root``: the end of each chain of ``id, up``, by pointer doubling.  A form is more frequent than its word: no cycles."""
    ups = cut(ups, "forms")
    while True:
        above = ups.select(F.col("id").alias("up"), F.col("up").alias("next"))
        ahead = cut(ups.join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), "next"), "forms")
        ups = ahead.drop("next")
        if ahead.filter("next IS NOT NULL").isEmpty():
            return ups.withColumnRenamed("up", "root")


def _named(words: DataFrame, key: str, name: str, *more: Column) -> DataFrame:
    return words.select(F.col("id").alias(key), F.col("word").alias(name), *more)


def variants(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of distinct ``word, n``.

    Near words differ by exactly one inserted, deleted or replaced code point.  ``form`` is the near word of largest ``n`` (ties: the
    smallest in code-point order) where that is at least ``TIMES`` times the word's own, else null; ``root`` ends the chain of forms.
    An empty vocabulary gives an empty result; words of any length take part, a missing one does not.
    """
    # sorted first: numbers follow code-point order
    words = cut(words.filter("word IS NOT NULL").select("word", "n").orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    best = cut(neighbours(words).groupBy("id", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")), "near")
    best = best.select("id", "n_near", F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best.other")).alias("form_id"))
    chains = _roots(best.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("up"))).withColumnRenamed("root", "root_id")
    full = (words.join(best, "id", "left").join(chains, "id", "left")
            .join(_named(words, "form_id", "form", F.col("n").alias("form_n")), "form_id", "left")
            .join(_named(words, "root_id", "root"), "root_id", "left"))
    return full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n",
                       F.coalesce("root", "word").alias("root"))
