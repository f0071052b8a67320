"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the distinctive text of toxic
sample documents and one on that of ordinary ones.  Every window of a few words
is compressed with each; how much shorter the toxic dictionary makes it is the
window's evidence, turned into a log-likelihood ratio by a histogram of
calibration documents.  A document's sum over its windows, divided by the root of
their number, becomes a probability by a logistic curve fitted on the same
calibration documents.

Zstandard counts whole bytes, so what the dictionaries share would only add
noise: their content is the words that sample documents of one class have far
more often than those of the other, the most frequent nearest the end.  A filler
that both dictionaries hold opens each window, so no window falls back to stored
form and small savings count.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The classifier is fitted on at most so many labelled rows of each class, those of smallest id hash, whose texts have
#: at most ``SAMPLE_CHARS`` characters.  Scoring has no such bounds.
SAMPLE = {1: 1500, 0: 3000}
SAMPLE_CHARS = 50_000
#: Words of a window; least share of sample documents with a distinctive word (the best of these on the calibration
#: documents is taken), and how much more often than in the other class it must be.
WORDS = 4
SHARES = (0.01, 0.02, 0.03, 0.05)
TIMES = 20
LOW, HIGH = -12, 30
FILLER = bytes(range(128, 160))
TOXIC_AT = 0.7


@dataclass(frozen=True)
class Model:
    """Dictionary contents, log-likelihood ratio by saved bytes (LOW to HIGH), and the logistic curve."""

    ordinary: bytes
    toxic: bytes
    ratios: tuple[float, ...]
    slope: float
    offset: float


def _windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    return [FILLER + b" " + b" ".join(words[i:i + WORDS]) + b" " for i in range(0, len(words), WORDS)]


@lru_cache(4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple:
    params = zstandard.ZstdCompressionParameters.from_level(
        3, source_size=100, dict_size=len(toxic), min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0)
    return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                          compression_params=params).compress for x in (ordinary, toxic))


def saved(text: bytes, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes the toxic dictionary saves against the ordinary one, by window, within LOW to HIGH, counted from LOW."""
    plain, rude = _compressors(ordinary, toxic)
    return np.clip(np.array([len(plain(w)) - len(rude(w)) for w in _windows(text)], dtype=np.int64), LOW, HIGH) - LOW


def statistic(text: bytes, model: Model) -> float:
    found = saved(text, model.ordinary, model.toxic)
    return float(np.asarray(model.ratios)[found].sum() / np.sqrt(len(found))) if len(found) else 0.0


def probability(text: bytes, model: Model | None) -> float:
    if model is None:
        return 0.0
    return 1 / (1 + exp(-max(-30.0, min(30.0, model.slope * statistic(text, model) + model.offset))))


def _one_of_each(texts: list[bytes]) -> list[bytes]:
    """Of near-copies (one least hash of five words) the first, so that a copied text does not make its words typical."""
    seen, out = set(), []
    for text in texts:
        w = text.lower().split()
        key = min((xxhash.xxh64_intdigest(b" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))), default=0)
        if key not in seen:
            seen.add(key)
            out.append(text)
    return out


def _distinctive(own: list[bytes], other: list[bytes], share: float) -> bytes:
    mine, theirs = (Counter(w for t in texts for w in set(t.lower().split())) for texts in (own, other))
    least = max(3, share * len(own))
    words = [w for w, n in mine.items() if n >= least and n / len(own) >= TIMES * (theirs[w] + 0.5) / (len(other) + 1)]
    return b" " + b" ".join(sorted(words, key=lambda w: (mine[w], w))) + b" " + FILLER


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression on one feature, by Newton steps with a small ridge: slope, offset, loss."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-2 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += step
        if abs(step).max() < 1e-9:
            break
    margin = np.clip(design @ beta, -30, 30)
    return float(beta[0]), float(beta[1]), float((weight * np.log1p(np.exp(np.where(y > 0, -margin, margin)))).sum())


def _calibrated(toxic: list[bytes], ordinary: list[bytes], toxic_share: float, share: float) -> tuple[float, Model]:
    rude, plain = _distinctive(toxic[::2], ordinary[::2], share), _distinctive(ordinary[::2], toxic[::2], share)
    size = max(len(rude), len(plain))
    rude, plain = (b"\xff" * (size - len(x)) + x for x in (rude, plain))
    found = [[saved(t, plain, rude) for t in texts[1::2]] for texts in (toxic, ordinary)]
    counts = [np.bincount(np.concatenate(f), minlength=HIGH - LOW + 1) + 1.0 for f in found]
    ratios = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    x = [np.array([ratios[v].sum() / np.sqrt(max(1, len(v))) for v in f]) for f in found]
    y = np.concatenate([np.ones(len(x[0])), np.zeros(len(x[1]))])
    weight = np.concatenate([np.full(len(x[0]), toxic_share * len(y) / len(x[0])), np.full(len(x[1]), (1 - toxic_share) * len(y) / len(x[1]))])
    slope, offset, loss = _logistic(np.concatenate(x), y, weight)
    return loss, Model(plain, rude, tuple(map(float, ratios)), slope, offset)


def train(toxic: list[bytes], ordinary: list[bytes], toxic_share: float) -> Model | None:
    """A model from sample texts; every second text makes the dictionaries, the others calibrate.  None without both classes."""
    toxic, ordinary = _one_of_each(toxic), _one_of_each(ordinary)
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    return min((_calibrated(toxic, ordinary, toxic_share, share) for share in SHARES), key=lambda m: m[0])[1]


def held_out(doc_id: str | Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on a bounded sample of labelled rows that are not held out; an id labelled twice counts as toxic if either says so."""
    marked = (labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
              .filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")))
    share = marked.agg(F.avg("y")).first()[0]
    if share is None:
        return None
    texts = {}
    for y, rows in SAMPLE.items():
        ids = F.broadcast(marked.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows).select("id"))  # at most ``rows`` ids
        sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(ids, "id").filter(F.length("t") <= SAMPLE_CHARS)
        texts[y] = [r["t"].encode() for r in sample.orderBy(F.xxhash64("id"), "id", "t").limit(rows).collect()]
    return train(texts[1], texts[0], share)


def score(text: str | Column, model: Model | None) -> Column:
    """Probability that a text is toxic, 0 to 1; a missing text counts as empty; 0 without a model."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([probability(x.as_py() or b"", model) for x in texts.cast(pa.binary())], pa.float64())

    return F.arrow_udf(run, T.DoubleType())(F.col(text) if isinstance(text, str) else text)
