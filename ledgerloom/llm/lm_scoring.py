"""Language-model scoring by cross-entropy difference.

Two bigram models, one of trusted documents and one of the whole corpus, share
one vocabulary, one number of words and one smoothing.  A document's score is the mean over its words
of (loss under the background model - loss under the target model): the more
like the trusted documents, the higher.

Every word and every bigram of the corpus is counted, none is too rare, and every
trusted document counts for the target.  A word is the 64-bit hash of its text, so no
dictionary is held anywhere.

A task reads documents in chunks of ``CHUNK`` words and packs each chunk's (word, word before, document,
times) by bucket of the word: one packed row a chunk and bucket is all that is shuffled.  A bucket thus holds every occurrence of its words,
which gives the counts of its bigrams, of its words, and of its words as the word before; so each occurrence
takes the numerator of its own bigram and the denominator of the next, and sums by document are all that leaves.
Buckets hold about ``BUCKET`` words, so their number grows with the corpus.

Words with at least ``HOT_SHARE`` of all (at most 1 / HOT_SHARE) have their totals beforehand, and their bigrams go to buckets
by bigram.  Bigrams with that share (at most as many) have theirs too, and are scored where they are read: neither fills a bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, order_id, word_array

#: Share of all words from which a word's totals, or a bigram's, are known beforehand; results do not depend on it.
HOT_SHARE = 1e-4
#: Words of a chunk and of a bucket; results do not depend on them.
CHUNK = 1_000_000
BUCKET = 6_000_000
LEAST_BUCKETS = 12
#: Occurrences of a bucket that are worked on at a time; results do not depend on it.
PART = 500_000
#: Weight of the word's own probability in a bigram's.
PRIOR = 200.0
#: What stands before a document's first word.
START = 0
#: Size up to which bitmaps of the trusted ids are broadcast; results do not depend on it.
BITMAP_BYTES = 64 << 20
#: Words whose hashes a worker keeps at a time.
KNOWN = 300_000


@dataclass(frozen=True)
class Totals:
    """Sizes of both models, and the totals of hot words and bigrams, sorted.  Index 0 is the background, 1 the target."""

    words: tuple[int, int]
    documents: tuple[int, int]
    size: int
    hot: np.ndarray  # u8
    own: np.ndarray  # 2 x hot
    before: np.ndarray  # 2 x hot
    pairs: np.ndarray  # u8, of ``_pair``
    times: np.ndarray  # 2 x pairs

    def scale(self) -> tuple[float, float]:
        """What counts are multiplied by: the background's as if of as many words as the target's."""
        return (self.words[1] / self.words[0] if self.words[1] else 1.0), 1.0

    def above(self, side: int, times: np.ndarray, own: np.ndarray) -> np.ndarray:
        by, words = self.scale()[side], self.words[1] or self.words[0]
        return np.log(times * by + PRIOR * (own * by + 1.0) / (words + self.size))

    def below(self, side: int, before: np.ndarray) -> np.ndarray:
        return np.log(before * self.scale()[side] + PRIOR)


@dataclass(frozen=True)
class Model:
    """The counted documents, as read and with their weights (``row, text, b, t``), and their totals."""

    source: DataFrame
    rows: DataFrame
    totals: Totals


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) or 1
        return value


@dataclass(frozen=True)
class _Chunk:
    """Documents' words with the words before them; ``last`` marks a document's last word, ``doc`` counts from 0."""

    word: np.ndarray
    prev: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    rows: np.ndarray
    weight: np.ndarray  # 2 x documents


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Chunks of at most CHUNK words from ``row, text, b, t``; a longer document is cut into parts of several chunks."""
    known, held, filled = _Hashes(), [], 0

    def whole() -> _Chunk:
        sizes = [len(h[0]) for h in held]
        word, prev, last = (np.concatenate([h[i] for h in held]) for i in range(3))
        return _Chunk(word, prev, last, np.repeat(np.arange(len(held)), sizes), np.array([h[3] for h in held], "i8"),
                      np.array([h[4] for h in held], "i8").T)

    for batch in batches:
        for row, text, b, t in zip(*(batch.column(c) for c in ("row", "text", "b", "t")), strict=True):
            words = text.as_py().encode().split()
            if not words:
                continue
            word = np.fromiter(map(known.__getitem__, words), "u8", len(words))
            prev = np.concatenate([np.array([START], "u8"), word[:-1]])
            last = np.zeros(len(words), bool)
            last[-1] = True
            at, key, weight = 0, row.as_py(), (b.as_py(), t.as_py())
            while at < len(words):
                to = min(len(words), at + CHUNK - filled)
                held.append((word[at:to], prev[at:to], last[at:to], key, weight))
                filled, at = filled + to - at, to
                if filled == CHUNK:
                    yield whole()
                    held, filled = [], 0
    if held:
        yield whole()
    give_back()


def _pair(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit number of a bigram, by multiplying and folding."""
    x = (prev * np.uint64(0x9E3779B97F4A7C15)) ^ (word * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _find(among: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``x`` is in the sorted ``among``, and where."""
    if not len(among):
        return np.zeros(len(x), bool), np.zeros(len(x), int)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x, at


def _sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=n)


def _batch(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[part.split()[0] for part in schema.split(", ")])


WORDS = "word bigint, b bigint, t bigint, end_b bigint, end_t bigint"
PAIRS = "prev bigint, word bigint, b bigint, t bigint"
PACKS = "bucket int, pack binary"
SUMS = "row bigint, k double, t double, b double"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches):
        words, at = np.unique(c.word, return_inverse=True)
        sides = [_sums(at, w[c.doc], len(words)).astype("i8") for w in c.weight]
        ends = [_sums(at, w[c.doc] * c.last, len(words)).astype("i8") for w in c.weight]
        yield _batch(WORDS, [words.view("i8"), *sides, *ends])


def _count_pairs(hot: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            found, at = _find(hot, c.word)
            first, before = _find(hot, c.prev)
            both = found & (first | (c.prev == START))
            code = (at[both] * (len(hot) + 1) + np.where(first, before + 1, 0)[both])
            pairs, back = np.unique(code, return_inverse=True)
            if not len(pairs):
                continue
            sides = [_sums(back, w[c.doc[both]], len(pairs)).astype("i8") for w in c.weight]
            ends = np.concatenate([np.array([START], "u8"), hot])
            yield _batch(PAIRS, [ends[pairs % (len(hot) + 1)].view("i8"), hot[pairs // (len(hot) + 1)].view("i8"), *sides])

    return run


def _least(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype("u1")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _pack(totals: Totals, buckets: int, scored: bool) -> Callable:
    """Packs of (word, word before, document, times) by bucket, and sums of what is scored here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=1).compress
        for number, c in enumerate(_chunks(batches)):
            words, at = np.unique(np.concatenate([c.word, c.prev]), return_inverse=True)  # CHUNK < 2^20: ids below 2^21
            at = at.astype("u8")
            n = len(c.word)
            keys = (at[:n] << np.uint64(42)) | (at[n:] << np.uint64(21)) | c.doc.astype("u8")
            key, times = np.unique(keys, return_counts=True)
            end = np.zeros(len(key), bool)
            end[np.searchsorted(key, keys[c.last])] = True
            low = np.uint64(2**21 - 1)
            word, prev, doc = words[key >> np.uint64(42)], words[(key >> np.uint64(21)) & low], (key & low).astype("i8")
            whole = _pair(prev, word)
            hot, hot_at = _find(totals.hot, word)
            known, known_at = _find(totals.pairs, whole)
            known &= hot
            if scored and known.any():
                k, own_at, pair_at, where = times[known], hot_at[known], known_at[known], doc[known]
                follow, first = k - end[known], np.where(prev[known] == START, k, 0)
                sums = [_sums(where, first * totals.below(s, np.float64(totals.documents[s])) + follow * totals.below(s, totals.before[s][own_at])
                              - k * totals.above(s, totals.times[s][pair_at], totals.own[s][own_at]), len(c.rows)) for s in (1, 0)]
                made = pickle.dumps(("sums", c.rows, _sums(where, k, len(c.rows)), *sums), protocol=5)
                yield _batch(PACKS, [np.array([number % buckets], "i4"), [deflate(made)]])
            bucket = (np.where(hot, whole, _pair(word, word)) % np.uint64(buckets)).astype("i4")
            bucket[known] = buckets  # after all others
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a == b:
                    continue
                own = order[a:b]
                w, p = word[own], prev[own]
                pairs = _runs(w, p)
                runs = _runs(w[pairs])
                docs, local = np.unique(doc[own], return_inverse=True)
                made = ("pack", w[pairs][runs], _least(np.diff(runs, append=len(pairs))), p[pairs], _least(np.diff(pairs, append=len(own))),
                        _least(local), _least(2 * times[own] + end[own]), c.rows[docs], c.weight[:, docs].astype("i1"), scored)
                yield _batch(PACKS, [np.array([i], "i4"), [deflate(pickle.dumps(made, protocol=5))]])

    return run


class _Opened:
    """One pack: its words in order of hash, with the places where each word's bigrams and occurrences start."""

    def __init__(self, words, runs, prev, sizes, doc, times, rows, weight, scored) -> None:
        self.words, self.prev, self.sizes, self.doc, self.times, self.rows, self.weight, self.scored = words, prev, sizes, doc, times, rows, weight, scored
        self.runs = runs
        self.pair_at = np.concatenate([[0], np.cumsum(runs, dtype="i8")])
        self.at = np.concatenate([[0], np.cumsum(sizes, dtype="i8")])[self.pair_at]
        self.sums = np.zeros((3, len(rows)))

    def part(self, low: int, high: int) -> tuple | None:
        """Words, words before, sizes, documents, times, ends of the words from ``low`` to below ``high``."""
        a = int(np.searchsorted(self.words, np.uint64(low)))
        b = len(self.words) if high == 2**64 else int(np.searchsorted(self.words, np.uint64(high)))
        if a == b:
            return None
        pairs, own = slice(self.pair_at[a], self.pair_at[b]), slice(self.at[a], self.at[b])
        times = self.times[own].astype("i8")
        return np.repeat(self.words[a:b], self.runs[a:b]), self.prev[pairs], self.sizes[pairs], self.doc[own], times >> 1, times & 1


def _add_part(totals: Totals, packs: list[_Opened], low: int, high: int) -> None:
    """Add what the words from ``low`` to below ``high`` bring to the sums of each pack's documents."""
    met = [(p, part) for p in packs if (part := p.part(low, high)) is not None]
    if not met:
        return
    word, prev = (np.concatenate([part[i] for _, part in met]) for i in (0, 1))
    counts = []  # of each pack's bigrams: times of both sides, ends of both sides
    for p, (_, _, sizes, doc, times, end) in met:
        starts = np.cumsum(sizes, dtype="i8") - sizes
        counts.append(np.array([np.add.reduceat(x * w[doc], starts) for x in (times, end) for w in p.weight.astype("i8")]))
    counts = np.concatenate(counts, axis=1)
    order = np.lexsort((prev, word))
    starts, ends = _runs(word[order], prev[order]), _runs(word[order])
    words, pairs = word[order][ends], np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
    of_word = np.repeat(np.arange(len(ends)), np.diff(ends, append=len(order)))
    hot, hot_at = _find(totals.hot, words)
    above, below = np.empty((2, len(order))), np.empty((2, len(order)))
    for s in (0, 1):
        times, own = np.add.reduceat(counts[s][order], starts), np.add.reduceat(counts[s][order], ends)
        before = own - np.add.reduceat(counts[2 + s][order], ends)
        if hot.any():
            own[hot], before[hot] = totals.own[s][hot_at[hot]], totals.before[s][hot_at[hot]]
        above[s, order] = totals.above(s, times[pairs], own[of_word])
        below[s, order] = totals.below(s, before)[of_word]
    at = 0
    for p, (_, own_prev, sizes, doc, times, end) in met:
        if p.scored:
            pair = np.repeat(np.arange(at, at + len(own_prev)), sizes)
            first, n = np.where(prev[pair] == START, times, 0), len(p.rows)
            p.sums[0] += _sums(doc, times, n)
            for i, s in ((1, 1), (2, 0)):
                opening = totals.below(s, np.float64(totals.documents[s]))
                p.sums[i] += _sums(doc, first * opening + (times - end) * below[s][pair] - times * above[s][pair], n)
        at += len(own_prev)


def _score_bucket(totals: Totals) -> Callable:
    """Sums by document over all packs of one bucket, which is gone through by ranges of word hashes of about ``PART`` occurrences."""

    def run(table: pa.Table) -> pa.Table:
        inflate = zstandard.ZstdDecompressor().decompress
        out, packs = [], []
        for raw in table.column("pack"):
            kind, *rest = pickle.loads(inflate(raw.as_py()))
            if kind == "sums":
                kept = rest[1] > 0
                out.append([x[kept] for x in rest])
            else:
                packs.append(_Opened(*rest))
        n = 1 + sum(len(p.doc) for p in packs) // PART
        for i in range(n):
            _add_part(totals, packs, i * 2**64 // n, (i + 1) * 2**64 // n)
        out += [[p.rows, *p.sums] for p in packs if p.scored]
        columns = [np.concatenate([o[i] for o in out]) if out else np.array([], "f8") for i in range(4)]
        give_back()
        return pa.Table.from_batches([_batch(SUMS, [columns[0].astype("i8"), *columns[1:]])])

    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(order_id(doc_id), F.col(text)).alias("row"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"),
                       order_id(doc_id).alias("__id"))


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``t``: 1 if ``__id`` is among ``ids``, else 0.

    Ids travel as bitmaps of 4 KB for 32,768 neighbours and are broadcast up to ``BITMAP_BYTES``, so no text is shuffled; more of them,
    or scattered ids, meet the texts by a shuffle.
    """
    bits = ids.groupBy(F.bitmap_bucket_number("__id").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__id")).alias("__bits"))
    bits = cut(bits, "trusted")
    if 4096 * bits.count() > BITMAP_BYTES:
        return rows.join(ids.withColumn("t", F.lit(1)), "__id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    met = rows.withColumns({"__part": F.bitmap_bucket_number("__id"), "__bit": F.bitmap_bit_position("__id").cast("int")})
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.col("__bit") % 8).bitwiseAND(1)
    return met.join(F.broadcast(bits), "__part", "left").withColumn("t", F.coalesce(bit, F.lit(0)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Both models.  The target is all rows labelled 1; without any, both models are the background's."""
    ids = labels.filter(F.col(label) == 1).select(F.col(doc_id).cast("long").alias("__id")).filter("__id IS NOT NULL").distinct()
    source = _rows(docs, doc_id, text)
    rows = _marked(source, ids).select("row", "text", F.lit(1).alias("b"), "t")
    words = cut(rows.mapInArrow(_count_words, WORDS).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("b", "t", "end_b", "end_t"))), "words")
    n = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("b", "t", "end_b", "end_t")), F.count("*").alias("size")).first()
    often = F.col("b") >= HOT_SHARE * n["b"]  # at most 1 / HOT_SHARE
    found = sorted((r.word % 2**64, r.b, r.t, r.b - r.end_b, r.t - r.end_t) for r in words.filter(often).collect())
    hot = np.array([r[0] for r in found], "u8")
    own, before = (np.array([[r[i] for r in found] for i in s], "f8").reshape(2, len(found)) for s in ((1, 2), (3, 4)))
    pairs = rows.mapInArrow(_count_pairs(hot), PAIRS).groupBy("prev", "word").agg(F.sum("b").alias("b"), F.sum("t").alias("t")).filter(often)
    met = pairs.collect()
    codes = _pair(np.array([r.prev % 2**64 for r in met], "u8"), np.array([r.word % 2**64 for r in met], "u8"))
    order = np.argsort(codes)
    times = np.array([[r.b for r in met], [r.t for r in met]], "f8").reshape(2, len(met))[:, order]
    side = 2 if n["t"] else 1  # without trusted words the target is the background
    if side == 1:
        own, before, times = (np.array([x[0], x[0]]) for x in (own, before, times))
        rows = rows.withColumn("t", F.col("b"))
    words_of, documents = ((n["b"], n["t"]), (n["end_b"], n["end_t"])) if side == 2 else ((n["b"], n["b"]), (n["end_b"], n["end_b"]))
    return Model(source, rows, Totals(words_of, documents, n["size"] + 2, hot, own, before, codes[order], times))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score``: one row per row of ``docs``; all 0 without words.

    Any documents can be scored.  Those the model was fitted on are counted and scored in one pass; others travel beside the counted ones.
    A bigram or word that the corpus lacks has the smoothed loss.  Repeated rows score alike; a missing id or text is a row like any other.
    """
    asked = _rows(docs, doc_id, text)
    buckets = max(LEAST_BUCKETS, model.totals.words[0] // BUCKET)
    if asked.sameSemantics(model.source):
        packs = model.rows.mapInArrow(_pack(model.totals, buckets, True), PACKS)
    else:
        asked = asked.select("row", "text", F.lit(0).alias("b"), F.lit(0).alias("t"))
        packs = model.rows.mapInArrow(_pack(model.totals, buckets, False), PACKS).union(asked.mapInArrow(_pack(model.totals, buckets, True), PACKS))
    sums = packs.groupBy("bucket").applyInArrow(_score_bucket(model.totals), SUMS)
    sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("k", "t", "b")))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(order_id(doc_id), F.col(text)).alias("row"),
                      F.size(word_array(text)).cast("long").alias("n_words"))
    out = own.join(sums, "row", "left").select("doc_id", "n_words", *(F.coalesce(F.col(s) / F.col("k"), F.lit(0.0)).alias(c)
                                               for s, c in (("t", "target_loss"), ("b", "background_loss"))))
    return out.withColumn("score", F.col("background_loss") - F.col("target_loss"))
