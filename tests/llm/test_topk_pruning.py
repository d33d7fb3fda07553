"""Exact top-k: what the bounds prune, turned axes, and components near and beyond the range of scores."""

from __future__ import annotations

import numpy as np

from aspectra.llm import exact_topk as T


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def brute(x, queries, k=5, scale=256):
    ints = [[int(np.floor(scale * c)) for c in v] for v in x.tolist()]
    out = []
    for q in queries:
        score = [(-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in enumerate(ints) if i != q]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(score)[:k])]
    return out


def ask(df, **how):
    return sorted(map(tuple, T.top_k(df, df.where("vec_id % 50 = 0"), **how).collect()))


def test_rows_in_few_directions_are_pruned(spark):
    """Rows in 4 hidden directions of 64, mixed over all components: nearly all pairs are dropped by a bound."""
    rnd = np.random.default_rng(11)
    x = (rnd.normal(size=(3000, 4)) @ rnd.normal(size=(4, 64)) + rnd.normal(scale=0.02, size=(3000, 64))) / 8
    df = table(spark, x).repartition(3)
    assert ask(df) == sorted(brute(x, range(0, 3000, 50)))
    got = T.pruning(df, df.where("vec_id % 50 = 0")).first()
    assert got["pairs"] == 60 * 3000 and got["pruned"] > 0.9


def test_rows_that_spread_evenly_are_not_pruned_and_stay_exact(spark):
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(1500, 64))
    df = table(spark, x)
    assert ask(df) == sorted(brute(x, range(0, 1500, 50)))
    assert 0 <= T.pruning(df, df.where("vec_id % 50 = 0")).first()["pruned"] < 0.5


def test_bounds_hold_on_turned_axes_and_tighten():
    rnd = np.random.default_rng(13)
    x = np.floor(256 * rnd.normal(size=(400, 7)) @ rnd.normal(size=(7, 30))).astype(np.int64)
    turn = T.axes(x[:100])
    assert np.allclose(turn.T @ turn, np.eye(30))
    exact, before = T.products(x[:40], x), None
    for n in T.SEGMENTS:
        up = T.bounds(T.statistics(x[:40] @ turn, n), T.statistics(x @ turn, n))
        assert (up >= exact).all()
        assert before is None or (up <= before * (1 + 1e-6) + 1e-6 * np.abs(before) + 1).all()
        before = up


def test_large_components_stay_exact(spark):
    """Scores beyond 2^53 aren't exact as doubles; integers are."""
    rnd = np.random.default_rng(14)
    x = rnd.integers(-(1 << 19), 1 << 19, size=(120, 8)).astype(float) + 0.5
    x[1] = x[0]
    x[1][0] += 1 / 256
    want = sorted(brute(x, range(0, 120, 50)))
    assert max(abs(s) for *_, s in want) > 1 << 53
    assert ask(table(spark, x)) == want


def test_vectors_beyond_the_range_of_scores_take_no_part(spark):
    x = np.array([[1.0, 2.0], [3.0, 1.0]] + [[0.0, 1.0]] * 5)
    huge = np.array([[1e300, 1.0], [-1e18, 0.0], [1.7e308, -1.7e308]])
    df = table(spark, x).unionByName(table(spark, huge, 48 + 2)).unionByName(table(spark, np.zeros((0, 2))))
    assert ask(df) == sorted(brute(x, [0]))
    none = T.pruning(df.limit(0), df.limit(0)).first()
    assert (none["pairs"], none["scored"], none["pruned"]) == (0, 0, None)
