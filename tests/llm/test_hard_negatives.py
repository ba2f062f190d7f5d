import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=5, percent=80):
    kept = [(key, label, [math.floor(256 * x) for x in v]) for key, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(k, (lab + 1) % 10 if k is not None and k % 7 == 0 else lab, v) for k, lab, v in kept]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for at, (key, label, vector) in enumerate(kept):
        if key is None or key % 100:
            continue
        scored = [(min(max(sum(x * y for x, y in zip(vector, v, strict=False)), -(2**63)), 2**63 - 1), k, lab) for j, (k, lab, v) in enumerate(kept) if j != at]
        for p in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fits = sorted((s for s in scored if s[2] != label and percent * p[0] <= 100 * s[0] <= 100 * p[0]), key=order)
            out += [(key, p[1], k + 1, n[1], p[0], n[0]) for k, n in enumerate(fits[:negatives])]
    return sorted(out, key=str)


def random_rows(n, dims, seed, spread=0.13, labels=10, step=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(6)]
    return [(k * step, rng.randrange(labels), [c + rng.gauss(0, spread / 2) for c in rng.choice(centres)]) for k in range(n)]


def run(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, label int, embedding array<double>, score double, `row` string")
    got = hn.mine_vectors(frame.repartition(parts)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    return sorted(map(tuple, got), key=str)


AWKWARD = [
    (100, 1, []), (200, None, [0.1] * 8), (300, 2, None), (400, 3, [0.1, None] + [0.2] * 6), (500, 4, [float("nan")] * 8), (600, 5, [float("inf")] * 8), (None, 1, [0.3] * 8), (None, 2, [0.3] * 8),
    (900, 1, [0.3] * 8), (901, 2, [0.3] * 8), (902, 2, [0.3] * 8), (1000, 3, [0.5, 0.5]), (1001, 4, [0.5, 0.5, 0.0, 0.0]), (1100, 8, [-0.5] * 8), (1101, 9, [-0.5] * 8), (1200, 77, [0.0] * 8), (1201, 77, [0.0] * 8), (1202, 6, [0.0] * 8),
]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 4)
    monkeypatch.setattr(hn, "CHUNK", 3)
    monkeypatch.setattr(hn, "HELD_BLOCKS", 2)
    rows = random_rows(900, 8, 1, step=2)
    found = run(spark, rows)
    assert found == brute(rows) and len(found) > 100


def test_ties_nulls_repeats_and_lengths(spark):
    rows = AWKWARD + random_rows(60, 8, 2, step=50) + [(1300, 5, [0.25] * 8)] * 2 + [(1300, 6, [0.25] * 8)] * 7 + [(k, 1, [0.5] * 8) for k in range(2000, 2040)] + [(k, 2, [0.5] * 8) for k in range(3000, 3040)]
    assert run(spark, rows) == brute(rows)


def test_very_large_components(spark):
    rng = random.Random(4)
    rows = [(k * 20, rng.randrange(2), [rng.choice([1.0, -3.0, 1e5, 2.5e6]) * rng.random() for _ in range(4)]) for k in range(60)]
    assert run(spark, rows) == brute(rows)
    huge = [(k * 50, k % 2, [1e20 * (k + 1), 1.0]) for k in range(6)] + [(1000 + k, k % 2, [1e-20 * k, 3.0]) for k in range(4)]
    assert run(spark, huge) == brute(huge)


def test_planes_give_exact_scores_and_drop_rows():
    rng = np.random.default_rng(6)
    for largest in (3, 40, 30_000, 2**28):
        anchors, rows = rng.integers(-largest, largest + 1, (7, 16)).astype(float), rng.integers(-largest, largest + 1, (500, 16)).astype(float)
        block = hn.Block(rows, np.arange(500), np.zeros(500), np.zeros((500, 0), np.int64))
        truth = np.array([[sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in rows] for a in anchors], dtype=object)
        ai, ci, s = hn.narrowed(anchors, block.planes, np.ones((7, 500), bool), hn.Greatest(5, np.full(7, -np.inf)))
        assert all(truth[i, j] == int(x) for i, j, x in zip(ai, ci, s, strict=True))
        for k in range(7):
            assert set(np.argsort(-truth[k])[:5]) <= set(ci[ai == k].tolist()) and (ai == k).sum() < 20


def test_few_pairs_reach_the_lower_planes(monkeypatch):
    rng = np.random.default_rng(8)
    anchors, rows = np.floor(256 * rng.normal(0, 0.125, (64, 64))), np.floor(256 * rng.normal(0, 0.125, (4000, 64)))
    seen = []
    sparse = hn.Greatest.sparse
    monkeypatch.setattr(hn.Greatest, "sparse", lambda self, a, low, high: seen.append(len(a)) or sparse(self, a, low, high))
    block = hn.Block(rows, np.arange(4000), np.zeros(4000), np.zeros((4000, 0), np.int64))
    hn.narrowed(anchors, block.planes, np.ones((64, 4000), bool), hn.Greatest(5, np.full(64, -np.inf)))
    assert len(seen) >= 2 and seen[-1] < 0.01 * 64 * 4000


def test_other_parameters(spark):
    rows = random_rows(200, 5, 11)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hn.mine(hn.shifted_labels(frame), F.col("vec_id") % 100 == 0, positives=2, negatives=3, percent=50).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2, 3, 50)


@pytest.mark.parametrize("rows", [[], [(100, 1, [0.5])], [(100, 1, [0.5]), (101, 2, [0.5])], [(1, 1, [0.5]), (2, 2, [0.4])]])
def test_nothing_to_find(spark, rows):
    assert run(spark, rows) == []
