"""Exact top-k against brute force."""

import math
from fractions import Fraction

import numpy as np

from kindred.llm import max_score


def brute(rows, queries, k):
    floor = lambda x: math.floor(1024 * Fraction(x))
    good = [(i, [floor(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in queries:
        if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        qi = [floor(x) for x in v]
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(qi, c)))), i) for i, c in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, queries, **options):
    df = lambda x: spark.createDataFrame([(*r, "x") for r in x], "vec_id long, embedding array<double>, score string")
    return sorted(map(tuple, max_score.top_k(df(rows), df(queries), **options).collect()))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=12) * rng.choice([1, 3])]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # ties
    rows += [rows[3], rows[3], (500, None), (501, [1.0, None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (None, [1.0] * 12), (504, [2.0] * 3), (505, []), (506, [5.0] * 20)]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    for block in (7, 1000):
        assert run(spark, rows, queries, k=10, block=block) == brute(rows, queries, 10)
    assert run(spark, rows[:4], rows[:2], k=10) == brute(rows[:4], rows[:2], 10)
    assert run(spark, rows, []) == [] and run(spark, [], queries[:2]) == []


def test_huge_components(spark):
    rows = [(1, [1e30, 2.0]), (2, [1e30, -3.0]), (3, [-1e30, 1.0]), (4, [1e9, 1e9])]
    assert run(spark, rows, rows, k=3) == brute(rows, rows, 3)
    rows += [(5, [1e306, 0.5]), (6, [-1.7e308, 1.7e308]), (7, [5e-324, 1e16 + 2])]
    assert run(spark, rows, rows, k=3) == brute(rows, rows, 3)


def test_vectors_without_components(spark):
    rows = [(3, []), (1, []), (2, [])]
    assert run(spark, rows, rows, k=2) == brute(rows, rows, 2)
    rows += [(4, [1.0, 2.0]), (5, [])]
    for block in (1, 10):
        assert run(spark, rows, rows, k=3, block=block) == brute(rows, rows, 3)


def test_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    postings, query = np.floor(rng.normal(size=(32, 3000)) * 300), np.floor(rng.normal(size=32) * 300)
    low, high, full = postings.min(axis=1), postings.max(axis=1), query @ postings
    for threshold in (-np.inf, 0.0, float(np.sort(full)[-10]), float(full.max())):
        at, scores = max_score.search(query, postings, low, high, threshold)
        got = dict(zip(at.tolist(), scores.tolist()))
        assert all(got.get(i) == full[i] for i in np.flatnonzero(full >= threshold))
