"""Interval algebra over run tables: rows [s, e) of integer positions, grouped by key columns.

Every operator takes the key columns that tell interval sets apart, so each is one shuffle on those keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by(keys: list[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def encode(pixels: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Sorted positions to runs: neighbours share position - rank."""
    rank = F.row_number().over(_by(keys).orderBy(index))
    islands = pixels.withColumn("_i", F.col(index) - rank)
    return islands.groupBy(*keys, "_i").agg(F.min(index).alias("s"), (F.max(index) + 1).alias("e")).drop("_i")


def decode(runs: DataFrame, out: str = "idx") -> DataFrame:
    """Runs to positions."""
    rest = [c for c in runs.columns if c not in ("s", "e")]
    return runs.where("e > s").select(*rest, F.explode(F.sequence("s", F.col("e") - 1)).alias(out))


def union(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the intervals of each key; touching intervals become one."""
    order = _by(keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("s") > reach)).cast("int")
    marked = runs.select(*keys, "s", "e").withColumn("_new", new)
    marked = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def vote(runs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Where at least ``least`` of the intervals of a key cover a position."""
    if least <= 1:
        return union(runs, keys)
    ends = runs.select(*keys, F.col("s").alias("p"), F.lit(1).alias("d")).unionByName(
        runs.select(*keys, F.col("e").alias("p"), F.lit(-1).alias("d"))
    )
    steps = ends.groupBy(*keys, "p").agg(F.sum("d").alias("d"))
    order = _by(keys).orderBy("p")
    level = steps.withColumn("v", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)))
    level = level.withColumn("e", F.lead("p").over(order)).where(F.col("v") >= least)
    return union(level.select(*keys, F.col("p").alias("s"), "e"), keys)


def votes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, e, votes): the stretches that equally many intervals of a key cover, one at least; neighbours differ in votes."""
    ends = runs.where("e > s").select(*keys, F.col("s").alias("p"), F.lit(1).alias("d"))
    ends = ends.unionByName(runs.where("e > s").select(*keys, F.col("e").alias("p"), F.lit(-1).alias("d")))
    steps = ends.groupBy(*keys, "p").agg(F.sum("d").alias("d")).where("d <> 0")
    order = _by(keys).orderBy("p")
    level = steps.withColumn("votes", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return level.select(*keys, F.col("p").alias("s"), F.lead("p").over(order).alias("e"), "votes").where("votes > 0")


def split_by_votes(stretches: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The intervals that stay of ``votes``' stretches when places with fewer than ``least`` votes go."""
    return union(stretches.where(F.col("votes") >= least).select(*keys, "s", "e"), keys)


def concat_sort(tables: list[DataFrame], keys: list[str], then: list[str]) -> DataFrame:
    """The intervals of all tables, numbered from 0 within a key by start, end and the columns ``then``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumn("place", (F.row_number().over(_by(keys).orderBy("s", "e", *then)) - 1).cast("long"))


def invert(runs: DataFrame, keys: list[str], size: Column | int) -> DataFrame:
    """What the intervals of each key leave of [0, size); keys without rows have no complement."""
    size = size if isinstance(size, Column) else F.lit(size).cast("long")
    flat = union(runs, keys)
    order = _by(keys).orderBy("s")
    gaps = flat.select(*keys, F.col("e").alias("s"), F.coalesce(F.lead("s").over(order), size).alias("e"))
    head = flat.groupBy(*keys).agg(F.lit(0).cast("long").alias("s"), F.min("s").alias("e"))
    return gaps.unionByName(head).where("e > s")


def chunk(runs: DataFrame, width: int) -> DataFrame:
    """Runs cut at multiples of ``width``, with the number of their chunk."""
    rest = [c for c in runs.columns if c not in ("s", "e")]
    first, last = F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)
    cut = runs.where("e > s").select(*rest, "s", "e", F.explode(F.sequence(first, last)).alias("chunk"))
    lo, hi = F.greatest("s", F.col("chunk") * width), F.least("e", (F.col("chunk") + 1) * width)
    return cut.select(*rest, "chunk", lo.alias("s"), hi.alias("e"))


def enclosing(boxes: DataFrame, keys: list[str], lows: list[str], highs: list[str]) -> DataFrame:
    """The box around all boxes of a key."""
    return boxes.groupBy(*keys).agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])


def merge_instances(runs: DataFrame, boxes: DataFrame, keys: list[str], lows: list[str], highs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Runs and boxes of the instances of a key as those of one instance."""
    return union(runs, keys), enclosing(boxes, keys, lows, highs)


def covered_twice(ranges: DataFrame) -> DataFrame:
    """Zones of one axis that at least two of the distinct ranges cover."""
    return vote(ranges.select("s", "e").distinct(), [], 2)
