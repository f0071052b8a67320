"""Exact removal of repeated byte strings by prefix-free parsing.

Triggers, chosen by a rolling hash, cut every document into phrases.  A trigger
is the least hash of ``TRIGGER`` bytes inside a string of ``LENGTH`` bytes, so it
depends on that string alone: equal strings have equal triggers wherever they
stand.  The strings that share a trigger occurrence are one phrase; a phrase's
text runs to the end of its last string, so neighbours overlap.  Every string of
the corpus starts in exactly one phrase.

1. Dictionary: phrases meet by trigger.  One whose text also occurs in a
   document of smaller id is repeated as a whole; only the first of each text
   stays in the dictionary.
2. Dictionary phrases that share a trigger with one of another document bring
   their text together, and their suffixes of ``LENGTH`` bytes are put in order:
   equal suffixes become neighbours, and all but those of the smallest document
   are repeated.
3. Spans go back to their documents.

The order of whole suffixes over the entire parse is not built: only equality
of ``LENGTH`` bytes matters here, and a phrase text holds such a string whole.
Triggers travel packed, whole hashes of trigger (less the bucket, which is its remainder) and text, and compressed places and ids each; the number of
buckets follows the bytes of the corpus, so no task grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, order_id

LENGTH = 50
TRIGGER = 20
#: Bytes of text for each bucket of triggers, and of text packed at a time.
BUCKET_BYTES = 8_000_000
PACK_BYTES = 4_000_000
#: Phrase texts packed at a time, and buckets of phrase texts for each bucket of triggers: their suffixes need more room.
PACK_TEXTS = 20_000
FINER = 4
U = np.uint64
BASE = 0x5851F42D4C957F2D
PACKED = "bucket int, buckets int, trigger binary, text binary, places binary, rows binary, ids binary"
BROUGHT = "bucket int, trigger binary, places binary, ids binary, rows binary, text binary"
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _power(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        rows = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            row = np.full(size, base, U)
            row[0] = 1
            rows.append(np.cumprod(row, dtype=U))
        _powers[:] = rows
    return _powers


def _batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over the batches of a task; what it held goes back once it has ended."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _powers.clear()
        give_back()

    return task


def _group(run: Callable[[pa.Table], pa.Table]):
    """``run`` on one bucket; what it held goes back once it has ended."""
    def task(table: pa.Table) -> pa.Table:
        out = run(table)
        _powers.clear()
        give_back()
        return out

    return task


def _prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; the hash of data[i:j] is (p[j] - p[i]) / BASE^i."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    m, s = x, 1
    while 2 * s <= width:
        m, s = np.minimum(m[:-s], m[s:]), 2 * s
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - s:width - s + n])


def phrases(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trigger, first and last string start, and text hash of each phrase; empty below LENGTH bytes."""
    if len(data) < LENGTH:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    p, inverse = _prefix(data), _power(len(data) + 1)[1]
    least = _least(_mix((p[TRIGGER:] - p[:-TRIGGER]) * inverse[:len(data) - TRIGGER + 1]), LENGTH - TRIGGER + 1)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = np.append(0, change), np.append(change - 1, len(least) - 1)
    end = last + LENGTH
    return least[first], first, last, _mix((p[end] - p[first]) * inverse[first]) ^ _mix((end - first).astype(U))


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of equal length, compressed byte by byte: all lowest bytes first, so that the empty high ones cost nothing."""
    planes = np.stack([c.astype("<i8") for c in columns]).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _spread(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(n, -1)


def _pack(buckets: int):
    def pack(rows: list[tuple[int, int]], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        trigger, first, last, text = (np.concatenate(x) for x in zip(*found, strict=True))
        which = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        bucket = (trigger % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        keys, ids = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        out: list[list] = [[] for _ in range(7)]
        for a, b in zip(edges[:-1], edges[1:]):
            at = order[a:b]
            used, local = np.unique(which[at], return_inverse=True)
            for column, value in zip(out, (
                    int(bucket[at[0]]), buckets, _squeeze(trigger[at] // U(buckets)), text[at].astype("<u8").tobytes(), _squeeze(np.diff(local, prepend=0), np.diff(first[at], prepend=0), last[at] - first[at]),
                    keys[used].astype("<i8").tobytes(), _squeeze(np.diff(ids[used], prepend=0))), strict=True):
                column.append(value)
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                          names=[x.split()[0] for x in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, size = [], [], 0
        for batch in batches:
            for key, doc, raw in zip(*(c for c in batch.columns), strict=True):
                data = np.frombuffer(raw.as_buffer() or b"", np.uint8)
                if len(data) < LENGTH:
                    continue
                rows.append((key.as_py(), doc.as_py()))
                found.append(phrases(data))
                size += len(data)
                if size >= PACK_BYTES:
                    yield pack(rows, found)
                    rows, found, size = [], [], 0
        if rows:
            yield pack(rows, found)

    return _batches(run)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the row above."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _meet(table: pa.Table) -> pa.Table:
    """Phrases of one bucket: those repeated as a whole, without their trigger, and those whose trigger another document shares."""
    got: list[list[np.ndarray]] = [[] for _ in range(6)]
    for r in table.to_pylist():
        trigger = (_spread(r["trigger"], 1)[0].view(U) * U(r["buckets"]) + U(r["bucket"])).view(np.int64)  # the bucket is its remainder
        text = np.frombuffer(r["text"], "<u8")
        local, first, length = _spread(r["places"], 3)
        local, first = np.cumsum(local), np.cumsum(first)
        rows, ids = np.frombuffer(r["rows"], "<i8"), np.cumsum(_spread(r["ids"], 1)[0])
        for column, value in zip(got, (trigger, text, ids[local], rows[local], first, length), strict=True):
            column.append(value)
    trigger, text, doc, row, first, length = (np.concatenate(x) for x in got)
    order = np.lexsort((doc, length, text, trigger))
    trigger, text, doc, row, first, length = (x[order] for x in (trigger, text, doc, row, first, length))
    by_trigger = _firsts(trigger)
    by_text = by_trigger | _firsts(text, length)
    whole = doc > doc[by_text][np.cumsum(by_text) - 1]
    stay = np.flatnonzero(~whole)
    starts = np.flatnonzero(_firsts(trigger[stay]))
    spread = np.maximum.reduceat(doc[stay], starts) > np.minimum.reduceat(doc[stay], starts)
    shared = stay[np.repeat(spread, np.diff(np.append(starts, len(stay))))]
    at = np.concatenate([np.flatnonzero(whole), shared])
    return pa.table({"row": row[at], "start": first[at].astype(np.int32), "stop": (first + length + LENGTH)[at].astype(np.int32),
                     "trigger": pa.array(trigger[at], mask=whole[at]), "whole": whole[at]})


def _bring(buckets: int):
    """Texts of dictionary phrases, packed by bucket of their trigger."""
    names = [x.split()[0] for x in BROUGHT.split(", ")]
    types = [pa.int32(), *[pa.binary()] * 5]

    def pack(cells: list[tuple]) -> pa.RecordBatch:
        trigger, start, doc, key = (np.array(x, dtype=np.int64) for x in list(zip(*cells, strict=True))[:4])
        bucket = trigger % buckets
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        out: list[list] = [[] for _ in names]
        for a, b in zip(edges[:-1], edges[1:]):
            at = order[a:b]
            texts = [cells[i][4] for i in at]
            for column, value in zip(out, (int(bucket[at[0]]), trigger[at].astype("<i8").tobytes(),
                                           _squeeze(start[at], np.array([len(t) for t in texts])), doc[at].astype("<i8").tobytes(),
                                           key[at].astype("<i8").tobytes(), b"".join(texts)), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[tuple] = []
        for batch in batches:
            for key, doc, raw, marks in zip(*batch.columns, strict=True):
                data, key, doc = raw.as_buffer(), key.as_py(), doc.as_py()
                for trigger, start, stop in zip(*(marks.values.field(i).to_pylist() for i in range(3)), strict=True):
                    cells.append((trigger, start, doc, key, data[start:stop].to_pybytes()))
                if len(cells) >= PACK_TEXTS:
                    yield pack(cells)
                    cells = []
        if cells:
            yield pack(cells)

    return _batches(run)


def _order(table: pa.Table) -> pa.Table:
    """Suffixes of the phrases of one bucket in order: spans of strings that a smaller document also has."""
    got: list[list[np.ndarray]] = [[] for _ in range(5)]
    texts = []
    for r in table.to_pylist():
        start, size = _spread(r["places"], 2)
        trigger, doc, row = (np.frombuffer(r[k], "<i8") for k in ("trigger", "ids", "rows"))
        for column, value in zip(got, (trigger, start, size, doc, row), strict=True):
            column.append(value)
        texts.append(r["text"])
    trigger, start, size, doc, row = (np.concatenate(x) for x in got)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offset = np.append(0, np.cumsum(size)[:-1])
    n = size - LENGTH + 1
    phrase = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = offset[phrase] + within
    p, inverse = _prefix(data), _power(len(data) + 1)[1]
    suffix = _mix((p[at + LENGTH] - p[at]) * inverse[at])
    order = np.lexsort((doc[phrase], trigger[phrase], suffix))
    first = _firsts(suffix[order], trigger[phrase][order])
    dup = np.zeros(len(order), dtype=bool)
    dup[order] = doc[phrase][order] > doc[phrase][order][first][np.cumsum(first) - 1]
    hit = np.flatnonzero(dup)
    new = _firsts(phrase[hit], hit - np.arange(len(hit)))
    head, tail = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
    return pa.table({"row": row[phrase[head]], "start": (start[phrase[head]] + within[head]).astype(np.int32),
                     "stop": (start[phrase[tail]] + within[tail] + LENGTH).astype(np.int32)})


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({"__doc": order_id(doc_id), "__row": F.xxhash64(order_id(doc_id), F.col(text))})


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, start, stop``: byte spans to remove, by row hash (xxhash64 of id and text); they may overlap."""
    own = _keyed(docs, doc_id, text).select("__row", "__doc", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    total = own.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = min(65_536, 1 + total // BUCKET_BYTES)
    found = cut(own.select("__row", "__doc", "raw").mapInArrow(_pack(buckets), PACKED).groupBy("bucket")
                .applyInArrow(_group(_meet), "row bigint, start int, stop int, trigger bigint, whole boolean"), "phrases")
    ask = (found.filter("NOT whole").groupBy(F.col("row").alias("__row"))
           .agg(F.collect_set(F.struct("trigger", "start", "stop")).alias("marks")))
    texts = own.join(ask, "__row").select("__row", "__doc", "raw", "marks")
    inner = cut(texts.mapInArrow(_bring(FINER * buckets), BROUGHT).groupBy("bucket").applyInArrow(_group(_order), "row bigint, start int, stop int"), "suffixes")
    return found.filter("whole").select("row", "start", "stop").union(inner)


def _cells(texts: pa.Array, lists: pa.Array) -> Iterator[tuple[bytes, int, int]]:
    """What remains of each text, its removed bytes and its removed runs."""
    for raw, cells in zip(texts, lists, strict=True):
        data = raw.as_buffer().to_pybytes() if raw.is_valid else b""
        if not cells.is_valid or not len(cells):
            yield data, 0, 0
            continue
        packed = np.sort(cells.values.to_numpy())
        start, stop = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
        new = np.append(True, start[1:] > stop[:-1])
        begin, end = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
        yield b"".join(data[a:b] for a, b in zip(np.append(0, end), np.append(begin, len(data)))), int((end - begin).sum()), len(begin)


def _remove(texts: pa.Array, lists: pa.Array) -> pa.Array:
    kept, removed, runs = ([*x] for x in zip(*_cells(texts, lists))) if len(texts) else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                                      names=["kept", "n_removed", "n_spans"])


def _remaining(texts: pa.Array, lists: pa.Array) -> pa.Array:
    return pa.array([kept.decode("utf-8", "ignore") for kept, _, _ in _cells(texts, lists)], pa.string())


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``__spans``: the packed spans to remove of each row, none where nothing repeats."""
    marks = spans(docs, doc_id, text).groupBy(F.col("row").alias("__row")).agg(
        F.collect_set(F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))).alias("__spans"))
    return _keyed(docs, doc_id, text).join(marks, "__row", "left")


def _raw(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``.

    Every byte covered by a string of LENGTH bytes that also starts in a document of smaller id is removed; strings are
    judged on the input and end with their document.  A missing text counts as empty, a missing id as the largest;
    rows of one id do not judge each other, and repeated rows come out alike.  An empty table stays empty.
    """
    plain = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    run = F.arrow_udf(_remove, "kept binary, n_removed bigint, n_spans bigint")
    out = _marked(docs.select(*plain), doc_id, text).withColumn("__out", run(_raw(text), F.col("__spans")))
    return out.select(*plain, "__out.kept", F.octet_length(_raw(text)).cast("long").alias("n_bytes"), "__out.n_removed", "__out.n_spans")


def rewrite(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the remaining text; a character that a cut has halved is dropped with it.  Missing texts become empty."""
    run = F.arrow_udf(_remaining, "string")
    return _marked(docs, doc_id, text).withColumn(text, run(_raw(text), F.col("__spans"))).select(*docs.columns)
