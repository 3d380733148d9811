"""Vantage-point search: exact with factor one, pruning, recall below it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import vptrees

DDL = "vec_id long, embedding array<float>, label int, kind int, id long, region int, vector string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, 6, 7, "x") for i, v in rows], DDL).repartition(5)


def exact(rows, k=10, every=4):
    """Every row's neighbours by plain comparison."""
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = max((sum(len(w) == n for _, w in good), n) for n in {len(v) for _, v in good})[1] if good else 0
    good = [(i, v) for i, v in good if len(v) == size]
    out = []
    for place, (i, v) in enumerate(good):
        if i % every == 0:
            others = []
            for other, (j, w) in enumerate(good):
                if other != place:
                    total = 0.0
                    for a, b in zip(v, w, strict=True):
                        total += (a - b) * (a - b)
                    others.append((math.sqrt(total), j))
            out += [(i, rank, j, d) for rank, (d, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def searched(spark, rows, factor=1.0, k=10):
    return sorted(tuple(r) for r in vptrees.nearest_neighbours(table_of(spark, rows), F.col("vec_id") % 4 == 0, k, factor).collect())


@pytest.fixture
def small(monkeypatch):
    """Many regions, shards and parts on small tables."""
    monkeypatch.setattr(vptrees, "SHARD_ROWS", 12)
    monkeypatch.setattr(vptrees, "QUERY_ROWS", 5)


def clusters(n, dims, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-9, 9) for _ in range(dims)] for _ in range(5)]
    return [(k, [c + rng.gauss(0, 0.5) for c in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("n,dims", [(240, 3), (60, 20), (3, 2), (1, 2)])
def test_exact(spark, small, n, dims):
    rows = clusters(n, dims, n)
    assert searched(spark, rows) == exact(rows)


def test_ties_repeats_hot_vectors_and_rows_that_take_no_part(spark, small):
    nan, inf = float("nan"), float("inf")
    grid = [(k, [float(k % 5), float(k % 3), 1.0]) for k in range(90)]  # 15 vectors, many ties
    hot = [(200 + k, [2.0, 2.0, 2.0]) for k in range(60)]
    repeated = [(8, [0.0, 0.0, 1.0]), (8, [0.0, 0.0, 1.0]), (8, [9.0, 0.0, 0.0])]
    odd = [(300, None), (304, []), (308, [0.0] * 3), (312, [nan, 1.0, 1.0]), (316, [1.0, inf, 1.0]), (320, [1.0, None, 1.0]), (324, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (-4, [1.0, 1.0, 1.0]), (328, [-0.0, 0.0, 1.0])]
    rows = grid + hot + repeated + odd
    got, want = searched(spark, rows), exact(rows)
    assert sorted(set(got) - set(want))[:9] == sorted(set(want) - set(got))[:9] and got == want
    assert searched(spark, rows, k=3) == exact(rows, k=3)


def test_large_values_keep_their_order(spark, small):
    rows = [(k, [1e30 * k, 3e38, -3e38]) for k in range(40)]
    assert searched(spark, rows) == exact(rows)


def test_empty(spark):
    assert searched(spark, []) == [] and searched(spark, [(4, None)]) == []


def test_pruning_passes_over_leaves_and_keeps_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, d = x[::40], np.sqrt(np.maximum(vptrees.squared(x[::40], x), 0))
    true = np.argsort(d, axis=1, kind="stable")[:, :10]
    tree, recall = vptrees.Tree(x, 5), {}
    for factor in (1.0, 0.2, 0.02):
        found = vptrees.search(tree, np.arange(len(x)), q, np.full(len(q), np.inf), 10, factor)
        recall[factor] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true, found.row, strict=True)])
    assert recall[1.0] == 1 and recall[0.2] >= 0.9 and recall[0.02] < recall[0.2]
    least = tree.lower_bounds(q)
    for leaf, rows in enumerate(tree.leaves):  # bounds hold
        assert (d[:, rows].min(axis=1) >= least[:, leaf] - 1e-6).all()
    near = np.array([v for _, v in clusters(4000, 8, 1)])
    tree = vptrees.Tree(near, 5)
    reach = np.sort(np.sqrt(np.maximum(vptrees.squared(near[:50], near), 0)), axis=1)[:, 10:11]
    assert (tree.lower_bounds(near[:50]) <= reach).mean() < 0.6  # clustered vectors are pruned without loss


def test_regions_hold_what_they_are_dealt():
    x = np.array([v for _, v in clusters(500, 4, 2)])
    tree = vptrees.Tree(x[:80], 3)
    leaf, least = tree.leaf_of(x), tree.lower_bounds(x[:40], tree.open_bounds())
    d = np.sqrt(np.maximum(vptrees.squared(x[:40], x), 0))
    assert (d >= least[:, leaf] - 1e-6).all()
