"""Growing markers over a mask, ring by ring, and what is built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.operators.raster import connected_pixels


def flood(mask: DataFrame, markers: DataFrame, axes: list[str] = ["y", "x"], max_rings: int = 100_000) -> DataFrame:  # noqa: B006
    """(axes, label): pixels of the mask that a marker reaches, by steps along the axes; the nearest marker counts.

    Markers equally near: the smallest label among the neighbours that were reached one step before.  Every ring is one
    join of the last ring with the mask; only what is new travels on.
    """
    reached = materialize(markers.join(mask.select(*axes), axes, "left_semi").select(*axes, "label"), "flood")
    ring = reached
    left = mask.select(*axes).join(reached, axes, "left_anti")
    steps = F.array(*[F.struct(*[F.lit(d if a == b else 0).cast("long").alias(b) for b in axes]) for a in axes for d in (-1, 1)])
    for _ in range(max_rings):
        moved = ring.select(F.explode(steps).alias("_d"), *axes, "label").select(*[(F.col(a) + F.col(f"_d.{a}")).alias(a) for a in axes], "label")
        ring = materialize(moved.groupBy(*axes).agg(F.min("label").alias("label")).join(left, axes, "left_semi"), "flood")
        if ring.limit(1).count() == 0:
            return reached
        reached = materialize(reached.unionByName(ring), "flood")
        left = mask.select(*axes).join(reached, axes, "left_anti")
    raise RuntimeError("markers were still growing")


def boundary_watershed(
    maps: DataFrame, seed_sem: float = 0.9, seed_contour: float = 0.8, fore: float = 0.85, seed_size: int = 32, min_size: int = 128, divisor: int = 1000
) -> DataFrame:
    """(y, x, label) from maps (y, x, sem, contour): seeds away from contours grow over the foreground.

    Seeds below ``seed_size`` and objects below ``min_size`` pixels are dropped; labels come after ``divisor``.
    """
    seeds = maps.select("y", "x", ((F.col("sem") > seed_sem) & (F.col("contour") < seed_contour)).cast("long").alias("v"))
    parts = connected_pixels(seeds, "v").select("y", "x", F.col("component").alias("label"))
    keep = lambda df, n: df.join(df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n).select("label"), "label", "left_semi")
    grown = flood(maps.where(F.col("sem") > fore).select("y", "x"), keep(parts, seed_size))
    done = materialize(keep(grown, min_size), "watershed")
    from runlattice.operators.objects import global_rank

    names = global_rank(done.select("label").distinct(), ["label"], [], "n")
    return done.join(names, "label").select("y", "x", (F.col("n") + divisor).alias("label"))


def split_label(pixels: DataFrame, label: str, which: int, points: DataFrame) -> DataFrame:
    """Pixels with one label split by marker points (y, x, k from 1): new labels follow the largest one."""
    top = pixels.agg(F.max(label).alias("_top"))
    part = pixels.where(F.col(label) == which).select("y", "x")
    grown = flood(part, points.select("y", "x", F.col("k").cast("long").alias("label")))
    out = pixels.join(grown.withColumnRenamed("label", "_new"), ["y", "x"], "left").join(F.broadcast(top))  # one row
    return out.withColumn(label, F.when(F.col("_new").isNotNull(), F.col("_new") + F.col("_top")).otherwise(F.col(label))).drop("_new", "_top")


def line_pixels(lines: DataFrame) -> DataFrame:
    """(line, y, x): pixels along lines (line, y1, x1, y2, x2), one for each step of the longer axis."""
    n = F.greatest(F.abs(F.col("y2") - F.col("y1")), F.abs(F.col("x2") - F.col("x1")))
    at = lines.select("line", "y1", "x1", "y2", "x2", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i"))
    share = F.when(F.col("n") > 0, F.col("i") / F.col("n")).otherwise(0.0)
    return at.select("line", *[F.floor(F.col(f"{a}1") + share * (F.col(f"{a}2") - F.col(f"{a}1")) + 0.5).alias(a) for a in "yx"])
