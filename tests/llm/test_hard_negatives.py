"""Hard negatives against brute force, with parts and leaves forced small."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score double, part string"


def brute(rows, every=10, k=5, low=80, high=100):
    best = {}
    for i, x, label, *_ in rows:
        if i is None or x is None or label is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        r = (label, [int(np.floor(256 * float(np.float32(c)))) for c in x])
        best[i] = min(best.get(i, r), r)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, other) for i, (other, w) in best.items() if i != a)
        for ps, p in [(-s, i) for s, i, other in scored if other == label][:k]:
            fit = [(i, -s) for s, i, other in scored if other != label and low * ps <= -100 * s <= high * ps][:k]
            out += [(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(fit)]
    return sorted(out)


def planted():
    rng = random.Random(11)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centre[i % 4]], rng.randrange(4), 0.0, "x") for i in range(500)]
    rows += [(1_000 + i, [0.5, 0.25, 0.0, 0.0, 1.0, 0.5], i % 2, 0.0, "hot") for i in range(250)]
    rows += [(2_000 + 10 * i, None if i == 0 else [float("nan")] * 6 if i == 1 else [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 0.0, None) for i in range(3)]
    rows += [(2_100, [1.0] * 6, None, 0.0, None), (None, [1.0] * 6, 1, 0.0, None), (2_110, [0.0] * 6, 7, 0.0, None), (2_120, [1.0, 2.0], 2, 0.0, None), (2_130, [], 2, 0.0, None)]
    rows += [rows[3], (10, [-1.0] * 6, 0, 0.0, "other"), (2_140, [-9.0] * 6, 9, 0.0, None), (2_141, [1.0] * 6, 9, 0.0, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part, leaf, group", [(2_048, 64, 16_384), (50, 4, 7)])
def test_hard_negatives(spark, monkeypatch, part, leaf, group):
    for name, value in (("PART_ROWS", part), ("LEAF_ROWS", leaf), ("GROUP_ROWS", group), ("SHARD_PARTS", 3 if part < 100 else 64), ("HELD", 2 if part < 100 else 16)):
        monkeypatch.setattr(H, name, value)
    rows = planted()
    vectors = H.labelled_vectors(spark.createDataFrame(rows, SCHEMA))
    found = sorted(tuple(r) for r in H.hard_negatives(vectors, F.col("vec_id") % 10 == 0).collect())
    want = brute(rows)
    assert len(want) > 500 and found == want


def test_hard_negatives_without_rows(spark):
    rows = [(1, [1.0], 1, 0.0, ""), (2, [2.0], 1, 0.0, "")]
    for some, condition in (([], F.col("vec_id") % 10 == 0), (rows, F.col("vec_id") % 10 == 0), (rows, F.col("vec_id") == 1)):
        vectors = H.labelled_vectors(spark.createDataFrame(some, SCHEMA))
        assert H.hard_negatives(vectors, condition).collect() == []


def test_queue_leaves_most_leaves_closed():
    """On clustered rows the boxes spare most leaves."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(16, 8)) * 200
    home = rng.integers(16, size=4_096)
    data = (centre[home] + rng.normal(size=(4_096, 8)) * 10).astype(np.int64)
    ids, labels = np.arange(4_096), home % 3
    parts = [H._pack(0, 0, ids, labels, data, np.zeros(len(ids), bool))]
    q = 200
    search = H.Search(ids[:q], labels[:q], data[:q], np.full((q, 1), -np.inf), np.full((q, 1), np.inf), 5, True)
    search.add(H.Leaves(parts, 8))
    assert search.opened < 0.3 * q * 4_096 / H.LEAF_ROWS
    dot = (data[:q].astype(np.float64) @ data.T.astype(np.float64))
    dot[labels[:q, None] != labels[None, :]] = -np.inf
    dot[np.arange(q), np.arange(q)] = -np.inf
    assert (np.sort(dot, axis=1)[:, ::-1][:, :5] == search.score[:, 0]).all()
