"""Spelling variants, shared search and label shards: brute force on odd rows, hot groups, empty tables."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import product
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import label_shards, shared_search, spelling
from ledgerloom.llm import queries as Q

SCHEMA = "doc_id bigint, text string, word string, n bigint, node string, shard string, rank string, score string, id string"
CLASH = ("x",) * 7


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(4)


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + c + word[i + 1:] for c in letters)


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    letters = sorted(set("".join(words)))
    out = {}
    for w, n in words.items():
        near = {e for e in edits(w, letters) if e in words and e != w}
        best = min(near, key=lambda v: (-words[v], v.encode()), default=None)
        out[w] = [n, len(near), best if best and words[best] >= 2 * n else None]
    for w, row in out.items():
        end = w
        while out[end][2]:
            end = out[end][2]
        row += [out[row[2]][0] if row[2] else None, end]
    return out


def got_variants(df):
    return {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in df.collect()}


def test_spelling_equals_brute_force(spark):
    rng = random.Random(5)
    stems = ["letter", "running", "aaaaaa", "abababab", "straße", "élève", "bookkeeper", "Ünder", "aaaaab"]
    text = []
    for _ in range(4000):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("aebtÀß") + w[i:], w[:i] + rng.choice("aebtÿ") + w[i + 1:]])
        text.append(w if rng.random() < 0.8 else w.upper())
    rows = [(i, " ".join(text[i::40])) for i in range(40)] + [(None, "nobody nobody nobody"), (3, None), (4, ""), (7, "x" * 30_000 + " long"),
                                                             (8, "twice twice"), (8, "twice twice"), (9, "日本語 letter÷×")]
    words = brute_words(rows)
    assert len(words) > 150
    got = got_variants(spelling.variants(spelling.vocabulary(frame(spark, rows))))
    assert got == brute_variants(words)
    assert max(v[1] for v in got.values()) > 5 and any(v[2] and v[4] != v[2] for v in got.values())


def test_spelling_damage_and_bounds(spark):
    doc = next(d for d in range(10_000) if crc32(f"{d}:meadow".encode()) % 97 == 0)
    short = next(d for d in range(10_000) if crc32(f"{d}:river".encode()) % 97 == 0)
    rows = [(doc, "meadow Meadow MEADOW"), (short, "river river river"), (doc + 97 * 97, "abcd abcd abcd")]
    assert {r.word: r.n for r in spelling.vocabulary(frame(spark, rows)).collect()} == brute_words(rows)
    none = spelling.vocabulary(frame(spark, [(1, None)]))
    assert spelling.variants(none).count() == 0 and spelling.variants(none.limit(0)).columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_one_letter_apart_is_linear_in_links(spark):
    """A hub word with every one-letter variant: each link once, both ways."""
    words = {"".join(p) + "stone": 3 for p in product("abcdefghij", repeat=2)}
    df = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(words.items())], "id bigint, word string, n bigint")
    links = [(r.id, r.other) for r in spelling.neighbours(df).collect()]
    assert len(links) == len(set(links)) == 100 * 18 and set(links) == {(b, a) for a, b in links}


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    held = [(doc, Counter(brute_terms(text))) for doc, text in docs]
    total, length = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(brute_terms(text))
    out = []
    for item, need in wanted.items():
        scores = []
        for doc, c in held:
            m = 50 + (50 * c.total() * total) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in need if c[t])
            if s > 0:
                scores.append((-s, 2**63 if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block_terms", [10**6, 12])
def test_search_equals_brute_force(spark, block_terms):
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "delta", "été", "Ünit", "x1", "42", "日本", "rare"]
    docs = [(i, " ,".join(rng.choices(words[:9], weights=[30, 20, 10, 5, 3, 3, 2, 2, 1], k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(None, "rare beta"), (None, "rare beta"), (5, "alpha"), (5, "alpha"), (900, None), (901, ""), (902, "!!"), (903, "rare " * 20_000)]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 8)))) for i in range(12)] + [(3, "rare"), (50, None), (51, "--"), (None, "beta"), (60, "absent")]
    got = shared_search.search(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id").withColumn("doc_id", F.lit(1)), 7,
                               block_terms=block_terms)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute_search(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs = frame(spark, [(1, "alpha")])
    items = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        got = shared_search.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_plan_shares_sets_and_is_exact():
    rng = np.random.default_rng(1)
    common = [{b"a", b"b", b"c"}, {b"d", b"e"}, {b"f", b"g", b"h", b"i"}]
    items = [set().union(*(c for c in common if rng.random() < 0.7)) | {b"own%d" % i} for i in range(60)] + [set(), {b"a"}]
    plan = shared_search.mine(items)
    value = {t: int(rng.integers(1, 1000)) for t in plan.terms}
    acc = [value[t] for t in plan.terms]
    for node, parts in plan.steps:
        assert node == len(acc) and max(parts) < node
        acc.append(sum(acc[p] for p in parts))
    assert [acc[n] if n >= 0 else 0 for n in plan.items] == [sum(value[t] for t in held) for held in items]
    assert plan.additions < sum(map(len, items)) / 2


def laws(rows, n):
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(n)) and max(counts[j] for j in range(n)) - min(counts[j] for j in range(n)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_keep_copies_together(spark):
    rng = random.Random(9)
    rows = [(i, f"single {i}") for i in range(2000)] + [(3000 + i, f"copy {rng.randrange(150)}") for i in range(900)]
    rows += [(5000 + i, "é" * 40) for i in range(1450)]  # a third of all rows, more than five shards
    rows += [(None, "copy 1"), (None, None), (7000, None), (7001, ""), (8, "single 8"), (9000, "word " * 50_000)]
    got = label_shards.shards(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    laws(got, 16)
    text = {(d, len((t or "").encode()) + 1, crc32((t or "").encode())): t or "" for d, t in rows}
    groups = defaultdict(Counter)
    for r in got:
        groups[text[r.doc_id, r.size, r.text_crc32]][r.shard] += 1
    few = [g for t, g in groups.items() if 1 < g.total() <= len(rows) / 16 / 2]
    assert len(few) > 100 and sum(len(g) == 1 for g in few) / len(few) > 0.97
    assert sum(n for n in sorted(groups["é" * 40].values())[-12:]) > 0.8 * 1450


def test_shards_follow_given_links(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(None, "a"), (5, "text 5")]
    chain = [(i, i + 1) for i in range(0, 200) if i % 10 != 9] + [(1, 1), (None, 3), (9999, 4)]
    links = spark.createDataFrame(chain, "a bigint, b bigint")
    docs = frame(spark, rows)
    got = label_shards.shards(docs, links, n=4)
    laws(got.collect(), 4)
    ends = got.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "shard").distinct()
    real = links.filter("a <> b AND b < 400")
    assert label_shards.cut_links(ends, real) < 0.45 * real.count()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(i, "same") for i in range(40)], [(None, None)] * 17])
def test_small_and_uniform_tables(spark, rows):
    got = label_shards.shards(frame(spark, rows) if rows else frame(spark, [(1, "")]).limit(0)).collect()
    assert len(got) == len(rows)
    laws(got, 16)


def test_allowed_moves_respect_quotas():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 8))
        quota = np.full(n, 100)
        load = rng.integers(40, 101, n)
        asked = rng.integers(0, 30, (n, n))
        np.fill_diagonal(asked, 0)
        asked = np.minimum(asked, (load // n)[:, None])
        move = label_shards.allowed(asked, load, quota)
        assert (move >= 0).all() and (move <= asked).all() and (load - move.sum(1) + move.sum(0) <= quota).all()


def test_movers_are_taken_exactly(spark):
    movers = spark.range(20_000).select(F.col("id").alias("node"), F.lit(0).alias("shard"), F.lit(1).alias("want"), F.lit(3).alias("reach"))
    got = label_shards._accepted(movers, np.array([30_000, 1_234]), np.array([20_000, 0]), 1)
    assert got.count() == got.distinct().count() == 1_234


def test_registered(spark, sf):
    rows = Q.QUERIES["op13_label_shards"](spark, sf).collect()
    laws(rows, 16)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got_variants(Q.QUERIES["op11_spelling_variants"](spark, sf)) == brute_variants(brute_words(docs))
