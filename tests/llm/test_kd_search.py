import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import kd_search as k


def brute(rows, top=10):
    good = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in good:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    for i, q in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:top])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score int, v string").repartition(3)


def random_rows(n, size, seed=0):
    return [(i, np.random.default_rng([seed, i]).normal(size=size).astype(np.float32).tolist()) for i in range(n)]


def found(spark, rows, **options):
    return sorted(map(tuple, k.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"shard": 40}, {"shard": 40, "block": 2}])
def test_against_brute_force(spark, options):
    rows = random_rows(450, 6)
    assert found(spark, rows, **options) == brute(rows)


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = random_rows(30, 4) + [(200, [0.5] * 4)] * 2 + [(i, [0.5] * 4) for i in range(210, 240)] + [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [float("nan")] * 4), (400, [float("inf")] * 4), (None, [1.0] * 4), (500, []), (600, [1.0, 2.0]), (601, [2.0, -1.0]), (700, [1.0] * 5)]
    assert found(spark, rows, shard=20) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e4, -2e4]), (1, [2.9e4, 1.5e4]), (2, [-1e4, 9e3]), (100, [1e5, 1e5])]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 50, (500, 5)), np.full((200, 5), 7)])
    tree = k.build(np.arange(700), points, 16)
    assert sorted(tree.ids.tolist()) == list(range(700)) and (tree.vectors == points[tree.ids]).all()
    for i in range(len(tree.left)):
        part = tree.vectors[tree.first[i] : tree.last[i]]
        assert (part.min(axis=0) == tree.low[i]).all() and (part.max(axis=0) == tree.high[i]).all()
        if tree.left[i] >= 0:
            j = tree.left[i]
            assert (tree.first[j], tree.last[j + 1]) == (tree.first[i], tree.last[i]) and tree.last[j] == tree.first[j + 1]
        else:
            assert len(part) <= 16 or (part == part[0]).all()


def test_traversal_leaves_nodes_out():
    """Points along an axis: a query opens the nodes at its end only."""
    points = np.stack([np.arange(4096), np.zeros(4096, np.int64)], axis=1)
    tree = k.build(np.arange(4096), points, 16)
    seen = []
    improve = k._improve
    try:
        k._improve = lambda rows, own, *rest: (seen.append(own), improve(rows, own, *rest))
        _, names, _ = k.search(tree, np.array([-1]), np.array([[3, 1]]), 10, np.array([np.iinfo(np.int64).min]), False)
    finally:
        k._improve = improve
    assert names.tolist() == list(range(4095, 4085, -1)) and len(seen) <= 2 < sum(tree.left < 0)
