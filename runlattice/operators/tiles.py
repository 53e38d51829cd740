"""Tiles of an image: layout, overlap zones, cutting up and putting together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.operators import intervals


def axis_ranges(length: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of nearly equal length, at most ``size``, that overlap by at least ``overlap`` and cover an axis."""
    if length <= size:
        return [(0, length)]
    if size <= overlap:
        raise ValueError("tiles must be larger than their overlap")
    n = math.ceil((length - overlap) / (size - overlap))
    return [(round(k * (length - size) / (n - 1)), round(k * (length - size) / (n - 1)) + size) for k in range(n)]


def tile_table(spark: SparkSession, height: int, width: int, size: int = 2048, overlap: int = 128) -> DataFrame:
    """(tile, ys, ye, xs, xe) of a grid."""
    rows = [(y1, y2, x1, x2) for y1, y2 in axis_ranges(height, size, overlap) for x1, x2 in axis_ranges(width, size, overlap)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tile long, ys long, ye long, xs long, xe long")


def overlap_zones(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """(y, s, e): runs of the flat image that two or more rows or columns of tiles cover; runs end with their row."""
    ys = intervals.covered_twice(tiles.select(F.col("ys").alias("s"), F.col("ye").alias("e")))
    xs = intervals.covered_twice(tiles.select(F.col("xs").alias("s"), F.col("xe").alias("e")))
    spark = tiles.sparkSession
    full = intervals.decode(ys, "y").select("y", F.lit(0).cast("long").alias("s"), F.lit(width).cast("long").alias("e"))
    part = spark.range(height).select(F.col("id").alias("y")).join(F.broadcast(xs))  # as many rows as seams
    both = intervals.union(full.unionByName(part.select("y", "s", "e")), ["y"])
    return both.select("y", (F.col("y") * width + F.col("s")).alias("s"), (F.col("y") * width + F.col("e")).alias("e"))


def to_global(runs: DataFrame, tiles: DataFrame, width: int) -> DataFrame:
    """Runs of tiles (tile, ..., s, e in the tile's flat index, split at its rows) in the flat index of the image."""
    placed = runs.join(F.broadcast(tiles), "tile")  # one row a tile
    w = F.col("xe") - F.col("xs")
    start = (F.floor(F.col("s") / w) + F.col("ys")) * width + F.pmod(F.col("s"), w) + F.col("xs")
    rest = [F.col(c) for c in runs.columns if c not in ("s", "e")]
    return placed.select(*rest, start.alias("s"), (start + F.col("e") - F.col("s")).alias("e"))


def crop_runs(runs: DataFrame, tiles: DataFrame, width: int, cell: int = 1024) -> DataFrame:
    """Runs of an image (y, s, e, split at rows) cut to each tile, in the tile's own flat index.

    Runs and tiles meet in the cells of a grid that they touch; a pair counts in the cell where the later one begins.
    """
    x1, x2 = F.col("s") - F.col("y") * width, F.col("e") - F.col("y") * width
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor((hi - 1) / cell)))
    rows = runs.agg((F.coalesce(F.max("y"), F.lit(0)) + 1).alias("_h"))  # one row
    placed = tiles.join(F.broadcast(rows)).where((F.col("ys") < F.col("_h")) & (F.col("ye") > F.col("ys")) & (F.col("xe") > F.col("xs")))
    placed = placed.withColumn("_cy", span(F.col("ys"), F.least("ye", "_h"))).withColumn("_cx", span(F.col("xs"), F.col("xe"))).drop("_h")
    celled = runs.where("e > s").withColumns({"_cy": F.floor(F.col("y") / cell), "_cx": span(x1, x2)})
    cut = celled.join(placed, ["_cy", "_cx"])
    cut = cut.where((F.col("y") >= F.col("ys")) & (F.col("y") < F.col("ye")) & (x1 < F.col("xe")) & (x2 > F.col("xs")))
    cut = cut.where(F.floor(F.greatest(x1, F.col("xs")) / cell) == F.col("_cx"))
    w = F.col("xe") - F.col("xs")
    lo, hi = F.greatest(x1, F.col("xs")), F.least(x2, F.col("xe"))
    base = (F.col("y") - F.col("ys")) * w - F.col("xs")
    rest = [F.col(c) for c in runs.columns if c not in ("s", "e", "y")]
    return cut.select("tile", *rest, (base + lo).alias("s"), (base + hi).alias("e"))


def cut_patches(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels with the patch they are in and their place there."""
    n = F.lit(size).cast("long")
    return pixels.withColumns(
        {"py": F.floor(F.col("y") / size), "px": F.floor(F.col("x") / size), "ty": F.pmod("y", n), "tx": F.pmod("x", n)}
    )


def pad_to(pixels: DataFrame, height: int, width: int, factor: int, value: str) -> DataFrame:
    """A dense grid grown to multiples of ``factor``, 0 where there was nothing."""
    h, w = -(-height // factor) * factor, -(-width // factor) * factor
    grid = pixels.sparkSession.range(h * w).select(F.floor(F.col("id") / w).alias("y"), F.pmod("id", F.lit(w)).alias("x"))
    return grid.join(pixels.select("y", "x", value), ["y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def join_patches(patches: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """The image of patches, without what padding added."""
    whole = patches.withColumns({"y": F.col("py") * size + F.col("ty"), "x": F.col("px") * size + F.col("tx")})
    return whole.where((F.col("y") < height) & (F.col("x") < width)).drop("py", "px", "ty", "tx")


def crops_at(points: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Points with the square of ``size`` around them, moved to lie inside the image."""
    lo = lambda c, n: F.greatest(F.lit(0).cast("long"), F.least(F.col(c) - size // 2, F.lit(max(0, n - size)).cast("long")))
    out = points.withColumns({"ys": lo("y", height), "xs": lo("x", width)})
    return out.withColumns({"ye": F.least(F.col("ys") + size, F.lit(height)), "xe": F.least(F.col("xs") + size, F.lit(width))})


def flipbooks(points: DataFrame, depth: int, around: int = 2) -> DataFrame:
    """Points (z) with their planes z - around to z + around that exist."""
    lo, hi = F.greatest(F.col("z") - around, F.lit(0).cast("long")), F.least(F.col("z") + around, F.lit(depth - 1).cast("long"))
    return points.withColumn("plane", F.explode(F.sequence(lo, hi)))


def downscale(pixels: DataFrame, value: str, factor: int) -> DataFrame:
    """Bilinear reduction by an even factor: the mean of the four pixels around the centre of each cell."""
    half = factor // 2
    near = (F.pmod("y", F.lit(factor).cast("long")).isin(half - 1, half)) & (F.pmod("x", F.lit(factor).cast("long")).isin(half - 1, half))
    cell = pixels.where(near).groupBy(F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x"))
    return cell.agg(F.avg(value).alias(value))


def upscale_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """Each cell as factor x factor pixels."""
    many = lambda c: F.explode(F.sequence(F.col(c) * factor, F.col(c) * factor + (factor - 1)))
    return cells.withColumn("y", many("y")).withColumn("x", many("x"))


def overlap_mask(tiles: DataFrame, start: str, stop: str) -> DataFrame:
    """(idx): the places along an axis that two tiles or more share."""
    return intervals.decode(intervals.vote(tiles.select(F.col(start).alias("s"), F.col(stop).alias("e")), [], 2))
