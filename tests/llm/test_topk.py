import math
import random

import numpy as np
import pytest

from sluice.llm import topk


def brute(rows, k=10):
    clean = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    asked = {}
    for i, v in clean:
        if i % 100 == 0:
            key = (i, len(v))
            asked[key] = min(asked.get(key, v), v)
    out = []
    for (i, d), q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in clean if j != i and len(v) == d)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [150, 20_000])
def test_like_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.gauss(0, 0.05) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)]  # a common vector
    rows += [(2000, None), (2001, []), (2002, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, [0.1] * 6)]
    rows += [(2200, [0.5, 0.25]), (2201, [1.0, 1.0]), (100, rows[100][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, i or 0, "x") for i, v in rows], "vec_id long, embedding array<double>, rank long, score string")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows)


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e9, 1.0]), (2, [1e9, 2.0]), (3, [-1e9, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = [(q, r, i, min(max(s, 1 - 2**63), 2**63 - 1)) for q, r, i, s in brute(rows)]
    assert [x[3] for x in sorted(tuple(r) for r in topk.top_k(df).collect())] == [x[3] for x in cut]


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    vectors = np.floor(1024 * (rng.normal(size=(8, 1, 16)) * 3 + rng.normal(size=(8, 200, 16)) * 0.1)).reshape(-1, 16)
    tree = topk.BallTree(vectors, 32)
    q = vectors[:5]
    norms = np.sqrt((q**2).sum(axis=1))
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert ((q @ vectors[rows].T).max(axis=1) <= tree.bounds(q, norms, np.full(5, node))).all()
    calls = []
    real = topk.exact_scores
    topk.exact_scores = lambda a, b: calls.append(len(a) * len(b)) or real(a, b)
    try:
        topk.search(np.arange(5), q, np.arange(len(vectors)), vectors, 10, np.full(5, -np.inf), 64)
    finally:
        topk.exact_scores = real
    assert sum(calls) < 0.5 * 5 * len(vectors)
