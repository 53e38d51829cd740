"""One-to-one matching that maximises the sum of scores: exact, component by component.

Pairs without an edge add nothing, so components of the edge graph can be solved apart; a task gets many
small components at once.  An edge that scores more than the best others of its two ends together is in every optimal
matching: such edges are taken first, which cuts a graph of neighbours that all hang together into small components.
What is left is solved on its edges; nothing here is as large as rows times columns.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.operators.graph import components

#: Edges that are left when no more sure ones are looked for, if some are found until then; edges of a task.
FEW, TASK_EDGES, MAX_ROUNDS = 100_000, 20_000, 40


def solve(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest sum, by shortest augmenting paths."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        j0 = 0
        slack, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            done[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~done[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < slack[free]
            slack[free[better]] = reduced[better]
            back[free[better]] = j0
            j1 = free[np.argmin(slack[free])]
            step = slack[j1]
            u[owner[done]] += step
            v[done] -= step
            slack[~done] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def solve_sparse(rows: list[list[tuple[int, float]]]) -> list[int | None]:
    """The column of each row, or None, in an assignment with the largest sum; ``rows``: (column, score > 0) of each row.

    Shortest augmenting paths over the edges; a row without a partner has a column of its own, of score 0.
    """
    own = 1 + max((j for row in rows for j, _ in row), default=0)
    u, v = [0.0] * len(rows), {}
    owner: dict[int, int] = {}
    mate: list[int] = [-1] * len(rows)
    for s, row in enumerate(rows):
        u[s] = min(-w - v.get(j, 0.0) for j, w in [*row, (own + s, 0.0)])
        dist, back, done, heap = {}, {}, {}, []
        i, base = s, 0.0
        while True:
            for j, w in [*rows[i], (own + i, 0.0)]:
                d = base - w - u[i] - v.get(j, 0.0)
                if j not in done and d < dist.get(j, math.inf):
                    dist[j], back[j] = d, i
                    heapq.heappush(heap, (d, j))
            base, j = heapq.heappop(heap)
            while j in done:
                base, j = heapq.heappop(heap)
            done[j] = base
            if j not in owner:
                break
            i = owner[j]
        for k, d in done.items():
            if k != j:
                v[k] = v.get(k, 0.0) + d - base
                u[owner[k]] -= d - base
        u[s] += base
        while True:
            i = back[j]
            owner[j], mate[i], j = i, j, mate[i]
            if i == s:
                break
    return [j if j < own else None for j in mate]


def _component_pairs(edges: pd.DataFrame) -> pd.DataFrame:
    """Matched edges of one component."""
    if len(edges) == 1:
        return edges
    rows, cols = pd.factorize(edges.a, sort=True)[0], pd.factorize(edges.b, sort=True)[0]
    links: list[list[tuple[int, float]]] = [[] for _ in range(rows.max() + 1)]
    for i, j, w in zip(rows.tolist(), cols.tolist(), edges.score.tolist()):
        links[i].append((j, w))
    mate = np.array([-1 if j is None else j for j in solve_sparse(links)])
    return edges[mate[rows] == cols]


def _sure(edges: DataFrame) -> DataFrame:
    """``edges`` with ``sure``: do they score more than the best other edges of both ends together?"""
    out = edges
    for c in "ab":
        tops = edges.groupBy(c).agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias(f"_{c}"))
        out = out.join(tops, c)
    other = lambda t: F.when(F.col("score") < F.get(t, 0), F.get(t, 0)).otherwise(F.coalesce(F.get(t, 1), F.lit(0.0)))
    return out.select("a", "b", "score", (F.col("score") > other("_a") + other("_b")).alias("sure"))


def match(edges: DataFrame, least: float = 0.0, buckets: int = 64, few: int = FEW) -> DataFrame:
    """(a, b, score) of the optimal matching of ``edges`` (a, b, score > 0), kept where score >= ``least``.

    The threshold applies to the solved matching, not to the edges.  Ids are any longs; equal scores are told
    apart by smaller ids.
    """
    left = materialize(edges.select("a", "b", "score").where("score > 0"), "match")  # read three times by each round
    taken = None
    for _ in range(MAX_ROUNDS):
        told = materialize(_sure(left), "match")
        found = told.where("sure").select("a", "b", "score")
        taken = found if taken is None else taken.unionByName(found)
        rest = told.where("not sure").select("a", "b", "score")
        left = materialize(rest.join(found.select("a"), "a", "left_anti").join(found.select("b"), "b", "left_anti").select("a", "b", "score"), "match")
        n = left.count()
        if n <= few or not found.limit(1).count():
            break
    # rows and columns get numbers of their own kind
    graph = left.select((F.col("a") * 2).alias("u"), (F.col("b") * 2 + 1).alias("v"))
    comps = components(graph, "assign")
    keyed = left.join(comps, F.col("id") == F.col("a") * 2).select("a", "b", "score", "component")
    keyed = keyed.withColumn("_k", F.pmod(F.xxhash64("component"), F.lit(max(buckets, n // TASK_EDGES + 1))))

    def solve_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["component", "a", "b"])
        parts = [_component_pairs(g) for _, g in pdf.groupby("component", sort=True)]
        return pd.concat(parts)[["a", "b", "score"]] if parts else pdf[["a", "b", "score"]]

    solved = keyed.groupBy("_k").applyInPandas(solve_bucket, "a long, b long, score double")
    return taken.unionByName(solved).where(F.col("score") >= least)
