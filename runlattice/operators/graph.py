"""Connected components of edge tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize

MAX_ROUNDS = 60
#: Tables of at most so many edges, a few megabytes, are finished in one task.
ONE_TASK = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )
    return pairs.where("u <> v").distinct()


def _joined(it):
    """(id, component) of all edges of the batches, by union-find."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in it:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_pydict({"id": ids, "component": [root(x) for x in ids]}, pa.schema([("id", pa.int64()), ("component", pa.int64())]))


def components(edges: DataFrame, name: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for all ends of ``edges`` (u, v): component is the smallest id that is reachable.

    Alternating large and small stars: every round is two joins with sizes of the order of the
    edges, written to the shared folder, and a long chain takes a logarithmic number of rounds.
    When at most ``one_task`` edges of whole numbers are there, one task finishes them instead.
    Self-loops and nulls are ignored; an empty table has no components.
    """
    now = edges.select(F.col("u"), F.col("v")).where("u <> v").distinct()
    now = materialize(now, name)
    whole = all(t in ("bigint", "int") for _, t in now.dtypes)
    if whole and now.limit(one_task + 1).count() <= one_task:
        kind = now.dtypes[0][1]
        found = now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "id long, component long")
        return materialize(found.select(F.col("id").cast(kind), F.col("component").cast(kind)), name, drop=(now,))
    seen = None
    for _ in range(MAX_ROUNDS):
        now = materialize(_small_star(_large_star(now)), name, drop=(now,))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
