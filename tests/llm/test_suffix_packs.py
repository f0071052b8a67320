"""Phrases travel in few bytes and come back whole."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import suffix_dedup as S


@pytest.mark.parametrize("columns", [1, 3])
def test_squeezed_columns_come_back(columns):
    rng = np.random.default_rng(1)
    values = [rng.integers(-2**63, 2**63 - 1, 500) for _ in range(columns)]
    values[0][:3] = [-2**63, 2**63 - 1, 0]
    assert (S._spread(S._squeeze(*values), columns) == np.stack(values)).all()


def test_packs_are_small_and_hold_every_phrase():
    rng = random.Random(2)
    texts = [bytes(rng.choices(range(97, 123), k=2_000)) for _ in range(400)]
    ids = [5_000_000_000 + i for i in range(398)] + [-4, 2**63 - 1]
    batch = pa.record_batch({"row": pa.array([i * 7919 for i in range(400)], pa.int64()), "doc": pa.array(ids, pa.int64()), "raw": pa.array(texts, pa.binary())})
    packs = pa.Table.from_batches(list(S._pack(16)(iter([batch]))))
    found = [S.phrases(np.frombuffer(t, np.uint8)) for t in texts]
    n = sum(len(f[0]) for f in found)
    assert packs.nbytes < 20.5 * n  # 21.2 bytes a phrase where triggers, ids and places travelled as whole integers
    want = sorted((int(t), int(a)) for f in found for t, a in zip(f[0].view(np.int64), f[1], strict=True))
    got, docs = [], set()
    for r in packs.to_pylist():
        trigger = S._spread(r["trigger"], 1)[0].view(np.uint64) * np.uint64(r["buckets"]) + np.uint64(r["bucket"])
        got += zip(trigger.view(np.int64).tolist(), np.cumsum(S._spread(r["places"], 3)[1]).tolist(), strict=True)
        docs |= set(np.cumsum(S._spread(r["ids"], 1)[0]).tolist())
    assert sorted(got) == want and docs == set(ids)
    # two documents of one text: the later one's phrases are repeated as a whole
    twice = pa.record_batch({"row": pa.array([1, 2], pa.int64()), "doc": pa.array([1, 2], pa.int64()), "raw": pa.array(texts[:1] * 2, pa.binary())})
    met = S._meet(pa.Table.from_batches(list(S._pack(1)(iter([twice]))))).to_pylist()
    assert {(m["row"], m["whole"], m["trigger"]) for m in met} == {(2, True, None)}
