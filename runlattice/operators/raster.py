"""Neighbourhood operators on dense pixels (y, x, value).

Windows along one axis do separable filters; shifted copies do the others.  Pixels that aren't there are
outside the image and are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.operators import intervals
from runlattice.operators.graph import components
from runlattice.operators.joins import overlaps


def _axis_window(keys: list[str], axis: str, radius: int):
    return W.partitionBy(*keys).orderBy(axis).rangeBetween(-radius, radius)


def box_max(pixels: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Largest value in the square of the radius: rows first, then columns."""
    rows = pixels.withColumn("_m", F.max(value).over(_axis_window(["y"], "x", radius)))
    return rows.withColumn(out, F.max("_m").over(_axis_window(["x"], "y", radius))).drop("_m")


def centers(pixels: DataFrame, value: str, threshold: float = 0.1, kernel: int = 7) -> DataFrame:
    """Local maxima above the threshold; equal neighbours all stay."""
    held = pixels.where(F.col(value).isNotNull())
    top = box_max(held, value, (kernel - 1) // 2, "_top")
    return top.where((F.col(value) == F.col("_top")) & (F.col(value) > threshold)).drop("_top")


def _neighbours(pixels: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    shifts = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in offsets])
    moved = pixels.select("y", "x", F.col(value).alias("_v"), F.explode(shifts).alias("_d"))
    return moved.select((F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x") + F.col("_d.dx")).alias("x"), "_v")


CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(a, b) for a in r for b in r if a * a + b * b <= radius * radius]


def morph(pixels: DataFrame, value: str, how: str, footprint: list[tuple[int, int]] = CROSS, times: int = 1) -> DataFrame:
    """Grey erosion ("min") or dilation ("max") of labels; (y, x, value)."""
    agg = {"min": F.min, "max": F.max}[how]
    out = pixels.select("y", "x", value)
    for _ in range(times):
        near = _neighbours(out, value, footprint).groupBy("y", "x").agg(agg("_v").alias(value))
        out = near.join(out.select("y", "x"), ["y", "x"], "left_semi")
    return out


def opened(pixels: DataFrame, value: str, footprint=CROSS) -> DataFrame:
    return morph(morph(pixels, value, "min", footprint), value, "max", footprint)


def closed(pixels: DataFrame, value: str, footprint=CROSS) -> DataFrame:
    return morph(morph(pixels, value, "max", footprint), value, "min", footprint)


def boundaries(pixels: DataFrame, label: str, thickness: int = 1) -> DataFrame:
    """(y, x, boundary): where labels change to the left, right, above or below, widened to the thickness."""
    wx, wy = W.partitionBy("y").orderBy("x"), W.partitionBy("x").orderBy("y")
    differs = F.lit(False)
    for w in (wx, wy):
        for step in (F.lag, F.lead):
            differs = differs | F.coalesce(step(label, 1).over(w) != F.col(label), F.lit(False))
    edge = pixels.withColumn("boundary", differs.cast("int")).select("y", "x", "boundary")
    return morph(edge, "boundary", "max", CROSS, thickness - 1) if thickness > 1 else edge


def pixel_runs(pixels: DataFrame, label: str) -> DataFrame:
    """(label, y, s, e): runs of equal labels above 0 within an image row; s and e are columns of it."""
    held = pixels.where(F.col(label) > 0).select("y", F.col(label).alias("label"), "x")
    return intervals.encode(held, ["label", "y"], "x")


def run_components(runs: DataFrame, diagonal: bool = True, width: int = 256, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Connected components of row runs: runs with ``component``, the smallest run id of it.

    Runs, not pixels, are the vertices; runs of neighbouring rows that touch (or overlap, without diagonals) are linked.
    """
    keyed = runs.withColumn("id", F.col("y") * (1 << 31) + F.col("s"))
    grown = 1 if diagonal else 0
    lower = keyed.select(*keys, "label", "id", "y", (F.col("s") - grown).alias("s"), (F.col("e") + grown).alias("e"))
    upper = keyed.select(*keys, "label", "id", (F.col("y") - 1).alias("y"), "s", "e")
    edges = overlaps(lower, upper, [*keys, "label", "y"], width).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    comps = components(edges, "run-components")
    return keyed.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))


def connected_pixels(pixels: DataFrame, label: str, diagonal: bool = True) -> DataFrame:
    """(y, x, label, component) of pixels above 0: components of equal labels."""
    runs = run_components(pixel_runs(pixels, label), diagonal)
    return intervals.decode(runs.select("y", "label", "component", "s", "e"), "x")


def fill_holes(pixels: DataFrame, label: str) -> DataFrame:
    """Background pixels enclosed by one label (no way over edges to the box of that label) get it."""
    props = pixels.where(F.col(label) > 0).groupBy(F.col(label).alias("_l")).agg(
        F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("x").alias("x1"), F.max("x").alias("x2")
    )
    rows = props.select("_l", "y1", "y2", "x1", "x2", F.explode(F.sequence("y1", "y2")).alias("y"))
    own = pixel_runs(pixels, label).select(F.col("label").alias("_l"), "y", "s", "e")
    # what a label leaves of each row of its box
    full = rows.select("_l", "y", "y1", "y2", "x1", "x2").join(own, ["_l", "y"], "left")
    w = W.partitionBy("_l", "y").orderBy("s")
    gap = full.select(
        "_l", "y", "y1", "y2", "x1", "x2", F.coalesce("e", "x1").alias("s"), F.coalesce(F.lead("s").over(w), F.col("x2") + 1).alias("e")
    )
    head = full.groupBy("_l", "y", "y1", "y2", "x1", "x2").agg(F.min("s").alias("_f")).where("_f is not null")
    head = head.select("_l", "y", "y1", "y2", "x1", "x2", F.col("x1").alias("s"), F.col("_f").alias("e"))
    gaps = gap.unionByName(head).where("e > s").distinct().withColumnRenamed("_l", "label")
    comp = run_components(gaps.select("label", "y", "s", "e"), diagonal=False)
    comp = comp.join(gaps, ["label", "y", "s", "e"])
    # run ids repeat between labels: a hole is told by label and component
    touches = (F.col("y") == F.col("y1")) | (F.col("y") == F.col("y2")) | (F.col("s") == F.col("x1")) | (F.col("e") == F.col("x2") + 1)
    open_ = comp.groupBy("label", "component").agg(F.max(touches.cast("int")).alias("_o")).where("_o = 0").select("label", "component")
    holes = intervals.decode(comp.join(open_, ["label", "component"]).select("label", "y", "s", "e"), "x")
    filled = holes.groupBy("y", "x").agg(F.min("label").alias("_fill"))
    out = pixels.join(filled, ["y", "x"], "left")
    return out.withColumn(label, F.when((F.col(label) == 0) & F.col("_fill").isNotNull(), F.col("_fill")).otherwise(F.col(label))).drop("_fill")


def center_offsets(pixels: DataFrame, label: str) -> DataFrame:
    """(y, x, label, oy, ox): offsets of each pixel of a label to the centroid of it."""
    held = pixels.where(F.col(label) > 0).select("y", "x", F.col(label).alias("label"))
    mid = held.groupBy("label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    return held.join(mid, "label").select("y", "x", "label", (F.col("cy") - F.col("y")).alias("oy"), (F.col("cx") - F.col("x")).alias("ox"))


def heatmap(pixels: DataFrame, label: str, sigma: float = 6.0, reach: float = 4.0) -> DataFrame:
    """(y, x, heat): the sum of Gaussians around the centroids' pixels, 1 at its top; objects with one centre pixel count once."""
    r = int(reach * sigma + 0.5)
    mid = pixels.where(F.col(label) > 0).groupBy(F.col(label).alias("label")).agg(F.floor(F.avg("y")).alias("cy"), F.floor(F.avg("x")).alias("cx")).select("cy", "cx").distinct()
    span = lambda c: F.explode(F.sequence(F.col(c) - r, F.col(c) + r))
    spots = mid.withColumn("y", span("cy")).withColumn("x", span("cx"))
    far = (F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2
    heat = spots.groupBy("y", "x").agg(F.sum(F.exp(-far / (2 * sigma * sigma))).alias("heat"))
    out = pixels.select("y", "x").join(heat, ["y", "x"], "left").withColumn("heat", F.coalesce("heat", F.lit(0.0)))
    top = out.agg(F.max("heat").alias("_top"))  # one row
    return out.join(F.broadcast(top)).select("y", "x", F.when(F.col("_top") > 0, F.col("heat") / F.col("_top")).otherwise(0.0).alias("heat"))


def crop_and_binarize(pixels: DataFrame, label: str) -> DataFrame:
    """(label, y, x, inside): the enclosing box of every label, cut out, 1 where a pixel has the label."""
    box = pixels.where(F.col(label) > 0).groupBy(F.col(label).alias("label"))
    box = box.agg(F.min("y").alias("_y1"), F.max("y").alias("_y2"), F.min("x").alias("_x1"), F.max("x").alias("_x2"))
    places = box.withColumn("y", F.explode(F.sequence("_y1", "_y2"))).withColumn("x", F.explode(F.sequence("_x1", "_x2")))
    held = places.join(pixels.select("y", "x", F.col(label).alias("_here")), ["y", "x"])
    return held.select("label", (F.col("y") - F.col("_y1")).alias("y"), (F.col("x") - F.col("_x1")).alias("x"), (F.col("_here") == F.col("label")).cast("int").alias("inside"))


#: Centres of a row of ``nearest_center``'s table of cells; cells with more have several rows.
LISTED = 4096


def nearest_center(pixels: DataFrame, points: DataFrame, y: Column, x: Column, cell: int = 8, rings: int = 2, listed: int = LISTED) -> DataFrame:
    """(pixels.*, center): the centre nearest to (y, x), ties to the lowest id; null without centres. ``points``: (center, cy, cx).

    Centres are listed with the cells around their own, so a pixel meets those of its neighbourhood in one equality join
    with lists, and no pair of a pixel and a centre is ever a row.  What has none within ``rings`` cells, or may have a
    nearer one beyond, is asked again with cells four times as wide, until nothing is left or one cell holds all.  Equal
    rows of ``pixels`` become one.
    """
    keys = [*pixels.columns, "_y", "_x"]
    ring = [(a, b) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1)]
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ring])
    dist = lambda p: (p["cy"] - F.col("_y")) ** 2 + (p["cx"] - F.col("_x")) ** 2
    left, done = pixels.withColumns({"_y": y, "_x": x}).distinct(), None
    while True:
        at = points.select("center", "cy", "cx", F.explode(moves).alias("_m"))
        at = at.select("center", "cy", "cx", (F.floor(F.col("cy") / cell) + F.col("_m.a")).alias("_a"), (F.floor(F.col("cx") / cell) + F.col("_m.b")).alias("_b"))
        n = at.groupBy("_a", "_b").count().agg(F.max("count")).first()[0] or 0
        parts = -(-n // listed)
        at = at.groupBy("_a", "_b", F.pmod(F.xxhash64("center"), F.lit(max(1, parts))).alias("_p")).agg(F.collect_list(F.struct("center", "cy", "cx")).alias("_c"))
        asked = left.withColumns({"_a": F.floor(F.col("_y") / cell), "_b": F.floor(F.col("_x") / cell)})
        best = F.array_min(F.transform("_c", lambda p: F.struct(dist(p).alias("d"), p["center"].alias("center"))))
        near = asked.join(at, ["_a", "_b"], "left").select(*keys, best.alias("_n"))
        if parts > 1:
            near = near.groupBy(*keys).agg(F.min("_n").alias("_n"))
        near = materialize(near, "nearest")
        sure = F.col("_n.center").isNotNull() & (F.col("_n.d") <= float(rings * cell) ** 2)
        told = near.where(F.coalesce(sure, F.lit(False)))
        done = told if done is None else done.unionByName(told)
        left = near.where(~F.coalesce(sure, F.lit(False))).drop("_n")
        far = left.agg(F.max(F.greatest(F.abs("_y"), F.abs("_x"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
        if far.n == 0:
            break
        top = points.agg(F.max(F.greatest(F.abs("cy"), F.abs("cx")))).first()[0]
        if top is None or rings * cell > 2 * 1.5 * max(far.m or 0, top, 1):  # no centres, or all were met
            done = done.unionByName(near.where(~F.coalesce(sure, F.lit(False))))
            break
        cell *= 4
    return done.select(*pixels.columns, F.col("_n.center").alias("center"))
