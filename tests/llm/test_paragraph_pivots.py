"""Large groups of near-copies that are not alike enough: the same links as by brute force, without spelling out their pairs."""

import random

from ledgerloom.llm import paragraph_dedup


def near_copies(n):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)]
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(80), rng.choice([1, 2, 2, 3, 3, 4])):
            words[k] = f"n{i}x{k}"
        texts.append(" ".join(words[rng.choice([0, 0, 0, 3]):]))
        if i % 40 == 0:  # a far text's own copy, one more word changed
            words[40] = f"other{i}"
            texts.append(" ".join(words))
    return texts


def classes_of(texts):
    """Class (first text) of each text, by all pairs."""
    words = [t.split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            common = len(x & y)
            if common >= 0.8 * (len(x) + len(y) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_far_copies_of_a_large_group(spark, monkeypatch):
    texts = near_copies(400)
    compared, alike = [], paragraph_dedup._alike

    def counted(pairs, sets):
        compared.append(pairs.count())
        return alike(pairs, sets)

    monkeypatch.setattr(paragraph_dedup, "_alike", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in paragraph_dedup.repeats(rows).collect()}
    assert [got[i] for i in range(len(texts))] == classes_of(texts)
    assert sum(compared) < 20 * len(texts), compared
