import itertools
import random

import numpy as np
import pytest

from runlattice.operators.assign import match, solve
from runlattice.operators.consensus import settle
from runlattice.operators.graph import components


def labels(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_random_edges(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = labels([e for e in edges if e[0] != e[1]])
    assert got == expected
    rounds = components(spark.createDataFrame(edges, "u long, v long"), one_task=0)  # stars, not one task
    assert {x.id: x.component for x in rounds.collect()} == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    for n, m in ((1, 4), (3, 3), (4, 2), (5, 5), (2, 6)):
        score = rng.random((n, m)) * (rng.random((n, m)) > 0.3)
        best = 0.0
        small, large = min(n, m), max(n, m)
        for p in itertools.permutations(range(large), small):
            best = max(best, sum(score[i, p[i]] if n <= m else score[p[i], i] for i in range(small)))
        assert sum(score[i, j] for i, j in solve(score)) == pytest.approx(best)


def test_match_filters_after_it_is_solved(spark):
    # the largest single score is not part of the optimum
    edges = [(1, 1, 0.55), (1, 2, 0.4), (2, 1, 0.4), (5, 9, 0.2)]
    got = {(r.a, r.b) for r in match(spark.createDataFrame(edges, "a long, b long, score double"), 0.3).collect()}
    assert got == {(1, 2), (2, 1)}


def test_settling_pushes_into_larger_and_pulls_smaller_clusters():
    assert settle({1: {1}, 2: {2, 3}, 4: {4, 5}}, {(1, 2), (1, 4)}) == {2: {1, 2, 3}, 4: {1, 4, 5}}
    assert settle({1: {1, 6}, 2: {2}, 4: {4, 5}}, {(1, 2), (1, 4)}) == {1: {1, 2, 4, 5, 6}}
    assert settle({1: {1}}, set()) == {1: {1}}


def test_sparse_assignment_equals_the_dense_one():
    from runlattice.operators.assign import solve_sparse

    r = np.random.default_rng(3)
    for _ in range(200):
        score = r.random((r.integers(1, 8), r.integers(1, 8))) * (r.random() < r.random(1))
        score = score * (r.random(score.shape) < 0.6)
        rows = [[(int(j), float(score[i, j])) for j in np.flatnonzero(score[i])] for i in range(len(score))]
        got = solve_sparse(rows)
        used = [j for j in got if j is not None]
        assert len(used) == len(set(used)) and all(j is None or score[i, j] > 0 for i, j in enumerate(got))
        assert sum(score[i, j] for i, j in enumerate(got) if j is not None) == pytest.approx(sum(score[i, j] for i, j in solve(score)))


def test_a_long_chain_of_neighbours_is_matched_on_its_edges(spark):
    """One component of 30,000 rows and columns, which is 7 GB as a table of all pairs; nine in ten edges are sure."""
    n, each = 30_000, 1.0
    edges = spark.range(n).selectExpr("id AS a", "id AS b", "CASE WHEN id % 10 < 9 THEN 0.9D ELSE 0.4D END AS score")
    edges = edges.unionByName(spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b", "0.3D AS score"))
    for few in (0, 1 << 40):
        got = match(edges, 0.0, few=few).selectExpr("count(*) AS n", "count(DISTINCT a) AS a", "count(DISTINCT b) AS b", "sum(score) AS s").first()
        assert got.n == got.a == got.b == n and got.s == pytest.approx(each * n * 0.85)
