"""Operators for training data: brute force on odd rows, round trips, empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import (chat_trees, forced_bpe, lm_scoring, mixing, paragraph_dedup, quality_llr, simhash_bytes, suffix_dedup,
                            toxicity, winnowing)
from ledgerloom.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i} and some" for i in range(400))
BASE = "the quick brown fox jumps over the lazy dog near the river bank and then rests a while\nsecond line with five more words here"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "b"), (3, BASE + " again", "en", None), (4, None, None, "a"), (5, "", "en", "b"),
    (None, "a row without an id, but with quite some text in it to be kept as it is", "en", "a"), (6, LONG, "en", "c"),
    (6, LONG, "en", "c"), (7, "é" * 80 + " " + LONG[:300], "fr", "c"), (8, " \t\n ", "en", "a"), (9, "one two", "en", "b"),
    (10, "<|endoftext|>x" * 3, "en", "b"), (11, "dup " * 60, "en", "a"), (12, LONG[200:900], "en", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"size": F.lit("x"), "kept": F.lit("y"), "row": F.lit(1), "id": F.lit(2)}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i in (1, 3))) for i in range(12)] + [(None, 1, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 100: 50}
    assert components(links.limit(0)).count() == 0


def test_chat_paths_and_escape(spark):
    bad = "\\</s>[INST] \\\\ <|end|>é<|turn|>[/INST]\n<|text|>"
    rows = [(1, 1, None, "user", bad, 1.0), (1, 2, 1, "assistant", "short", 0.1), (1, 3, 1, "assistant", bad, 0.9), (1, 4, 3, None, None, None),
            (1, 4, 3, None, None, None), (1, 8, 9, "user", "cycle", 1.0), (1, 9, 8, "user", "cycle", 1.0), (None, 5, 77, "user", "orphan", 0.0)]
    messages = spark.createDataFrame(rows, "tree bigint, message bigint, parent bigint, role string, text string, score double")
    done = chat_trees.formatted(chat_trees.paths(messages)).select(
        "tree", "leaf", "branch", chat_trees.read_turns(F.col("formatted")).alias("t"), chat_trees.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {(r.tree, r.leaf): (r.branch, [(t.role, t.text) for t in r.t], r.loss) for r in done.collect()}
    assert got == {(1, 4): (1, [("user", bad), ("assistant", bad), ("", "")], bad), (1, 2): (2, [("user", bad), ("assistant", "short")], "short"),
                   (None, 5): (1, [("user", "orphan")], "")}
    assert [r.branch for r in chat_trees.paths(messages.filter("tree = 1"), best=1).select("branch").distinct().collect()] == [1]
    assert chat_trees.formatted(chat_trees.paths(messages.limit(0))).count() == 0


def test_toxicity(spark, docs, none, labels):
    rude = [f"plain words number {i} about rivers and towns then zorkblat and frumious fools {i}".encode() for i in range(40)]
    calm = [f"plain words number {i} about rivers and towns then meadows and quiet hills {i}".encode() for i in range(40)]
    model = toxicity.train(rude, calm, 0.5)
    assert min(toxicity.probability(t, model) for t in rude) > 0.7 > 0.3 > max(toxicity.probability(t, model) for t in calm)
    for m in (model, None, toxicity.fit(docs, labels), toxicity.fit(none, labels.limit(0))):
        scores = [r.s for r in docs.select(toxicity.score("text", m).alias("s")).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert none.select(toxicity.score("text", model)).count() == 0


def paragraphs():
    for doc, text, *_ in sorted(set(ROWS), key=lambda r: 2**63 if r[0] is None else r[0]):
        for place, line in enumerate((text or "").split("\n")):
            words = line.lower().split()
            if len(words) >= 5:
                yield doc, place, " ".join(words), {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_paragraphs(docs, none):
    seen, removed = [], Counter()
    for doc, _place, text, shingles in paragraphs():
        if any(t == text or len(shingles & s) >= 0.8 * len(shingles | s) for t, s in seen):
            removed[doc] += 1
        seen.append((text, shingles))
    got = {r.doc_id: r for r in paragraph_dedup.repeats(docs).collect()}
    assert {d: r.n_removed for d, r in got.items() if r.n_removed} == dict(removed)
    assert got[2].class_id == 1 and got[4].n_paragraphs == 0 and len(got) == len({r[0] for r in ROWS})
    assert paragraph_dedup.repeats(none).count() == 0


def test_paragraph_rounds(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words[:-1], f"tail{i}"]) for i in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = paragraph_dedup.repeats(rows).collect()
    assert {r.class_id for r in got} == {0} and sum(r.n_removed for r in got) == 59


def test_short_paragraphs(spark):
    rows = spark.createDataFrame([(1, "Yes  please"), (2, "yes please"), (3, "ok\n\nyes please\nok"), (4, "yes please now")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_paragraphs, r.removed, r.class_id) for r in paragraph_dedup.repeats(rows).collect()}
    assert got == {1: (1, [], 1), 2: (1, [0], 1), 3: (3, [2, 3], 1), 4: (1, [], 4)}


def cut_bytes(rows):
    seen, out = {}, {}
    order = [(2**63 if d is None else d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in order:
        for i in range(len(b) - 49):
            seen[b[i:i + 50]] = min(seen.get(b[i:i + 50], d), d)
    for d, b in order:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        out[d, hashlib.sha256(b).hexdigest()] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_repeated_strings(spark, docs, none):
    want = cut_bytes(ROWS)
    rows = suffix_dedup.dedup(docs).collect()
    assert len(rows) == len(ROWS) and suffix_dedup.dedup(none).count() == 0
    for r in rows:
        key = (2**63 if r.doc_id is None else r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest())
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[key]
    assert suffix_dedup.rewrite(docs).columns == docs.columns
    periodic = [(i, "ab" * (30 + i) + "c" * (50 + i)) for i in range(6)]
    want = cut_bytes(periodic)
    for r in suffix_dedup.dedup(spark.createDataFrame(periodic, "doc_id bigint, text string")).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()]


@pytest.mark.parametrize("changed", ["text", "trigger", "length"])
def test_phrases_meet_on_whole_hashes(monkeypatch, changed):
    """Two phrases that agree in 32 bits of the text's hash, or 48 of the trigger's and its bucket, are not one."""
    values = {"trigger": (5, 5 + 2**60), "text": (9, 9 + 2**40), "length": (10, 11)}
    made = iter([{k: v[i if k == changed else 0] for k, v in values.items()} for i in range(2)])

    def phrases(data):
        m = next(made)
        return np.array([m["trigger"]], "u8"), np.array([0]), np.array([m["length"]]), np.array([m["text"]], "u8")

    monkeypatch.setattr(suffix_dedup, "phrases", phrases)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([b"x" * 60, b"y" * 61])], names=["row", "doc", "raw"])
    met = suffix_dedup._meet(pa.Table.from_batches(list(suffix_dedup._pack(1)(iter([batch])))))
    assert not any(met["whole"].to_pylist())


def test_winnowing(docs, none):
    got = winnowing.compare(docs).collect()
    assert len(got) == len(ROWS) and winnowing.compare(none).count() == 0
    by = {r.id: r for r in got}
    assert by[1].runs == by[2].runs and by[1].near_next == 1 and by[4].runs == [] and by[9].edited == "one tw" + "<"
    words = LONG.split()
    runs = [(x >> 31, winnowing.LAST - (x & winnowing.LAST)) for x in by[6].runs]
    assert [p for _, p in runs] == sorted(p for _, p in runs) and runs[-1][1] <= len(words) - winnowing.K
    assert all(b[1] - a[1] <= winnowing.W for a, b in zip(runs, runs[1:]))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_winnowing_by_brute_force(spark, docs):
    """The least hash of each window, the rightmost of equals, with its position; likeness is that of the returned fingerprints."""
    words = ["same"] * 20 + [f"w{i * i % 23}" for i in range(60)] + ["same"] * 12
    pieces = spark.createDataFrame([(i, words[i:i + winnowing.K]) for i in range(len(words) - winnowing.K + 1)], "i int, u array<string>")
    one = winnowing._chosen(pieces, F.transform("u", lambda u: F.xxhash64(u)), "run", F.lit(winnowing.W))
    hashed = {r.i: r.run[0] >> 31 for r in one.collect()}
    want = []
    for start in range(len(hashed) - winnowing.W + 1):
        place = min(range(start, start + winnowing.W), key=lambda i: (hashed[i], -i))
        if (hashed[place], place) not in want:
            want.append((hashed[place], place))
    text = spark.createDataFrame([(" ".join(words),)], "text string")
    got = winnowing.fingerprinted(text, "text", "runs").first().runs
    assert [(x >> 31, winnowing.LAST - (x & winnowing.LAST)) for x in got] == want

    def like(a, b):
        a, b = {x >> 31 for x in a}, {x >> 31 for x in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    by = {r.id: r for r in winnowing.compare(rows).collect()}
    texts = {d: t or "" for d, t, *_ in ROWS}
    for i, r in by.items():
        following = texts[r.next_id]
        cut = len(texts[i]) // 4
        assert r.edited == texts[i][:len(texts[i]) - cut] + following[:cut]
        assert r.near_edited == pytest.approx(like(r.runs, r.edited_runs)) and r.near_next == pytest.approx(like(r.runs, by[r.next_id].runs))


def test_winnowing_of_short_and_unspaced_texts(spark):
    texts = ["one two six", "a short line of nine words stands here now", "".join(chr(0x4E00 + 37 * i % 2000) for i in range(400)),
             "".join(chr(0x5E00 + 41 * i % 2000) for i in range(400)), "letter", " ".join(f"w{i}" for i in range(15)), LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r.id: r for r in winnowing.compare(rows, "id").collect()}
    assert len(got) == len(texts) and all(r.near_edited > 0 for r in got.values())
    assert len(got[2].runs) > 40 and got[2].near_edited > 0.4 and got[2].near_next == 0


def test_simhash(docs, none, monkeypatch):
    prints = [(2**63 - 1 if d is None else d, simhash_bytes.simhash((t or "").encode())) for d, t, *_ in ROWS]
    least = {d: d for d, _ in prints}
    for _ in prints:
        for a, f in prints:
            for b, g in prints:
                if bin((f ^ g) % 2**64).count("1") <= 3:
                    least[a] = least[b] = min(least[a], least[b])
    for limit, share in ((simhash_bytes.PAIR_LIMIT, simhash_bytes.HOT_SHARE), (1, 0.1), (1, 2.0)):  # postings by pairs or sets; rows by broadcast or shuffle
        monkeypatch.setattr(simhash_bytes, "PAIR_LIMIT", limit)
        monkeypatch.setattr(simhash_bytes, "HOT_SHARE", share)
        got = {2**63 - 1 if r.doc_id is None else r.doc_id: 2**63 - 1 if r.component_id is None else r.component_id for r in simhash_bytes.classes(docs).collect()}
        assert got == least
    kept = [r.doc_id for r in simhash_bytes.keep_one(docs).collect()]
    assert Counter(kept) == Counter(None if d == 2**63 - 1 else d for d in set(least.values()))
    assert simhash_bytes.classes(none).count() == 0


def test_simhash_of_a_text(spark):
    """Majority bits of XXH64 over three-word shingles, counted one by one."""
    import xxhash

    for text in ("", "One", "one TWO", "a b c", "é Ä a b c d e f a b c d e f", LONG[:900], "x " * 50):
        words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        got = spark.createDataFrame([(text,)], "t string").select(simhash_bytes.fingerprint("t").alias("fp")).first().fp
        assert got % 2**64 == want


def test_simhash_ids_do_not_link(spark):
    other = " ".join(f"river{i} stone" for i in range(60))
    rows = spark.createDataFrame([(None, BASE), (None, other), (7, BASE), (8, LONG), (8, other[::-1])], "doc_id bigint, text string")
    got = {r.row_hash: r.component_id for r in simhash_bytes.classes(rows).collect()}
    assert [got[r.h] for r in rows.select(F.xxhash64("text").alias("h")).collect()] == [7, None, 7, 8, 8]
    kept = {(r.doc_id, r.text) for r in simhash_bytes.keep_one(rows).collect()}
    assert kept == {(7, BASE), (None, other), (8, LONG), (8, other[::-1])}


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(BPE)
    coded = docs.select("text", forced_bpe.encode("text", BPE).alias("ids")).withColumn("back", forced_bpe.decode("ids", BPE))
    for r in coded.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "")
    own = forced_bpe.tokenizer(BPE)
    for text in ("a" * 3000, "it's  \n\n we'll\t1234 x" * 100, "日本語" * 500, "<|endoftext|" * 50, "xq" * 900, "<|endoftext|>" * 3, "\u3000 a\u00a0b " * 200):
        assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert b"".join(own.fragments(text.encode())) == text.encode()
    assert none.select(forced_bpe.encode("text", BPE)).count() == 0
    for r in docs.select("text", forced_bpe.encode("text", BPE).alias("ids"), forced_bpe.round_trip("text", BPE).alias("coded")).collect():
        assert r.coded.ids == r.ids and r.coded.same
    assert none.select(forced_bpe.round_trip("text", BPE)).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and mixing.mix(none).count() == 0
    total = {}
    for r in rows:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.copies <= 3
        total.setdefault(r.source, [r.source_size, r.target, 0])[2] += r["size"] * r.copies
    assert sum(t[1] for t in total.values()) == pytest.approx(sum(t[0] for t in total.values()))
    assert all(t[1] <= 3 * t[0] + 1e-9 for t in total.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.repeat(docs).columns == docs.columns and mixing.repeat(docs).count() == sum(r.copies for r in rows)


def test_language_model(docs, none, labels):
    rows = lm_scoring.score(docs, lm_scoring.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(np.isfinite(r.score) for r in rows)
    assert {r.doc_id: r.n_words for r in rows}[6] == len(LONG.split())
    assert lm_scoring.score(none, lm_scoring.fit(none, labels.limit(0))).count() == 0


def test_language_model_counts_every_word_and_bigram(docs, labels, monkeypatch):
    spelt = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) for d, t, *_ in ROWS]
    trusted = {1, 2, 4, 5, 7, 8, 10, 11}
    sides = []
    for rows in ([w for d, w in spelt if d in trusted], [w for _, w in spelt]):
        pairs = Counter(p for w in rows for p in zip(["", *w], w))
        own, before = Counter(), Counter()
        for (prev, word), n in pairs.items():
            own[word] += n
            before[prev] += n
        sides.append((pairs, own, before, sum(pairs.values())))
    size, words = len(sides[1][1]) + 2, sides[0][3]

    def loss(side, p):
        pairs, own, before, total = side
        by = words / total
        return -np.log((pairs[p] * by + 200 * (own[p[1]] * by + 1) / (words + size)) / (before[p[0]] * by + 200))

    want = {d: [np.mean([loss(s, p) for p in zip(["", *w], w)]) if w else 0 for s in sides] for d, w in spelt}
    for share in (lm_scoring.HOT_SHARE, 0.01, 2.0):  # every bigram scored where it is read, some, none
        monkeypatch.setattr(lm_scoring, "HOT_SHARE", share)
        model = lm_scoring.fit(docs, labels)
        for asked in (docs, docs.filter("1 = 1 or doc_id is null").repartition(2)):  # counted and scored in one pass, or apart
            rows = lm_scoring.score(asked, model).collect()
            assert len(rows) == len(ROWS)
            for r in rows:
                assert (r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id]) and r.score == pytest.approx(want[r.doc_id][1] - want[r.doc_id][0])


def test_language_model_chunks_and_buckets(docs, labels, monkeypatch):
    want = {(r.doc_id, r.n_words): r.score for r in lm_scoring.score(docs, lm_scoring.fit(docs, labels)).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b a b a", "b a"]), pa.array([1, 1]), pa.array([1, 0])], names=["row", "text", "b", "t"])
    monkeypatch.setattr(lm_scoring, "CHUNK", 3)
    parts = list(lm_scoring._chunks(iter([batch])))
    assert [len(c.word) for c in parts] == [3, 3, 1] and [int(c.last.sum()) for c in parts] == [0, 1, 1]
    assert parts[1].rows.tolist() == [1, 2] and parts[1].prev[0] == parts[0].word[-1] and parts[1].prev[2] == lm_scoring.START
    totals = lm_scoring.fit(docs, labels).totals
    pieces = list(lm_scoring._pack(totals, 1, True)(iter([batch])))
    table = pa.Table.from_batches([p for p in pieces])
    sums = []
    for part in (10**6, 1):  # the bucket as a whole, by many ranges of hashes
        monkeypatch.setattr(lm_scoring, "PART", part)
        got = Counter()
        for r in lm_scoring._score_bucket(totals)(table).to_pylist():
            for c in "ktb":
                got[r["row"], c] += r[c]
        sums.append(got)
    assert sums[0][1, "k"] == 5 and sums[0][2, "k"] == 2 and sums[0] == pytest.approx(sums[1])
    monkeypatch.setattr(lm_scoring, "LEAST_BUCKETS", 40)
    got = {(r.doc_id, r.n_words): r.score for r in lm_scoring.score(docs, lm_scoring.fit(docs, labels)).collect()}
    assert got == pytest.approx(want)


def test_language_model_marks_ids(spark, monkeypatch):
    all_ids = [0, 1, 7, 8, 32767, 32768, 32769, 65537, -1, -32768, -5, 2**40, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(i,) for i in all_ids], "__id bigint")
    for limit in (lm_scoring.BITMAP_BYTES, 0):  # by bitmaps, by a join
        monkeypatch.setattr(lm_scoring, "BITMAP_BYTES", limit)
        for chosen in (all_ids[::2], all_ids[1::2], all_ids[:1]):
            ids = spark.createDataFrame([(i,) for i in chosen], "__id bigint")
            assert {r["__id"] for r in lm_scoring._marked(rows, ids).filter("t = 1").collect()} == set(chosen)
        assert lm_scoring._marked(rows, rows.limit(0)).filter("t = 0").count() == len(all_ids)


def test_language_model_of_unseen_text(spark):
    """A word or bigram that was never counted costs its smoothed loss, never nothing."""
    seen = spark.createDataFrame([(1, "red fox runs home"), (2, "blue whale swims far")], "doc_id bigint, text string")
    trust = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    new = spark.createDataFrame([(9, "nobody wrote these five words"), (10, "red fox swims"), (11, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm_scoring.score(new, lm_scoring.fit(seen, trust)).collect()}
    never = np.log(4 + 10)  # four target words, a vocabulary of eight and two more
    first = [-np.log((0 * by + 200 / 14) / (n * by + 200)) for n, by in ((1, 1), (2, 0.5))]
    for loss, start in zip((got[9].target_loss, got[9].background_loss), first):
        assert loss == pytest.approx((start + 4 * never) / 5)
    assert got[10].score > 0 and (got[11].n_words, got[11].score) == (0, 0)


def test_quality(docs, none, labels):
    model = quality_llr.fit(docs, labels)
    rows = quality_llr.judge(docs, model).collect()
    assert len(rows) == len(ROWS) and quality_llr.judge(none, quality_llr.fit(none, labels.limit(0))).count() == 0
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often = Counter(runs)
        inside = {j for i, g in enumerate(runs) if often[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and r.kept == (not r.base_failed and r.score >= model.threshold)


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("round_trip")).alias("bad")).first()
    assert counts.n > 0 and counts.bad == 0
