"""Account hierarchies: deep chains, cycles, several parents, hot parents, against a plain walk."""

import random

from ledgerloom.operators import hierarchy as H


def edges(spark, rows):
    return spark.createDataFrame(rows, "ledger_id int, child string, parent string").repartition(3)


def types(spark, rows):
    return spark.createDataFrame(rows, "ledger_id int, node string, account_type string")


def up_of(rows):
    up = {}
    for g, c, p in rows:
        if c is not None and p is not None and c != p:
            up[g, c] = min(p, up.get((g, c), p))
    return up


def brute_closure(rows):
    up, out = up_of(rows), {}
    for g, n in up:
        at, d = n, 0
        while (g, at) in up and (at := up[g, at]) != n and (g, n, at) not in out:
            d += 1
            out[g, n, at] = d
    return out


def brute_types(rows, typed):
    up, kind = up_of(rows), {}
    for g, n, t in sorted((r for r in typed if None not in r[1:]), reverse=True):
        kind[g, n] = t
    nodes = set(up) | {(g, p) for (g, _), p in up.items()} | {(g, n) for g, n, _ in typed if n is not None}
    out = {}
    for g, n in nodes:
        at, d, seen = n, 0, set()
        while (g, at) not in kind and (g, at) in up and at not in seen:
            seen.add(at)
            at, d = up[g, at], d + 1
        hit = kind.get((g, at))
        out[g, n] = (hit, at if hit else None, d if hit else None, hit is None and at in seen)
    return out


def got_closure(df):
    rows = df.collect()
    out = {(r.ledger_id, r.node, r.ancestor): r.distance for r in rows}
    assert len(out) == len(rows)
    return out


def got_types(df):
    rows = df.collect()
    assert len({(r.ledger_id, r.node) for r in rows}) == len(rows)
    return {(r.ledger_id, r.node): (r.account_type, r.typed_by, r.distance, r.is_cyclic) for r in rows}


def test_deep_tree_cycles_and_odd_rows(spark):
    rows = [(1, f"n{i}", f"n{i + 1}") for i in range(37)] + [(1, f"leaf{i}", "n3") for i in range(50)]  # a chain and a hot parent
    rows += [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "below", "a"), (2, "under", "below"), (2, "typed ring", "other"), (2, "other", "typed ring")]
    rows += [(3, "self", "self"), (3, None, "x"), (3, "y", None), (3, "two", "zeta"), (3, "two", "alpha"), (3, "alpha", "top"), (3, "alpha", "top")]
    typed = [(1, "n37", "ASSET"), (1, "n20", "BANK"), (2, "typed ring", "TAX"), (3, "top", "B"), (3, "top", "A"), (3, "alone", "X"), (3, None, "Y"), (3, "two", None)]
    e, t = edges(spark, rows), types(spark, typed)
    assert got_closure(H.closure(e)) == brute_closure(rows)
    got = got_types(H.inherited_types(e, t))
    assert got == brute_types(rows, typed)
    assert got[1, "leaf7"] == ("BANK", "n20", 18, False) and got[2, "under"] == (None, None, None, True) and got[2, "other"] == ("TAX", "typed ring", 1, False)


def test_random_forests(spark):
    rng = random.Random(3)
    rows = [(g, f"n{i}", f"n{rng.randrange(i)}") for g in (1, 2) for i in range(1, 120)]
    rows += [(3, f"n{i}", f"n{rng.randrange(60)}") for i in range(60)]  # every node has a parent: cycles
    typed = [(g, f"n{rng.randrange(120)}", rng.choice("AB")) for g in (1, 2, 3) for _ in range(6)]
    assert got_closure(H.closure(edges(spark, rows))) == brute_closure(rows)
    assert got_types(H.inherited_types(edges(spark, rows), types(spark, typed))) == brute_types(rows, typed)


def test_empty(spark):
    e, t = edges(spark, [(1, "a", "b")]).limit(0), types(spark, [(1, "a", "T")])
    assert H.closure(e).count() == 0 and got_types(H.inherited_types(e, t)) == {(1, "a"): ("T", "a", 0, False)}
    assert H.inherited_types(e, t.limit(0)).count() == 0
