"""Whole workflows out of the single operators: maps to objects, stacks and views to filtered objects, scores by class."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.operators import consensus, intervals, metrics, objects, panoptic, raster
from runlattice.operators.assign import match
from runlattice.operators.joins import areas, overlaps

#: Labels are below this number, so that a class and a label make one id.
LABELS = 1 << 40


def thing_instances(maps: DataFrame, things: list[int], threshold: float = 0.1, kernel: int = 7) -> DataFrame:
    """(y, x, sem, ins) of maps (y, x, sem, ctr, oy, ox): number of the nearest centre on pixels of thing classes, else 0.

    Without any centre all are 0.
    """
    grouped = panoptic.group_pixels(maps.select("y", "x", "ctr", "oy", "ox"), threshold, kernel)
    ins = F.when(F.col("sem").isin(things), F.coalesce("ins", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return maps.select("y", "x", "sem").join(grouped, ["y", "x"]).select("y", "x", "sem", ins.alias("ins"))


def panoptic_segmentation(
    maps: DataFrame, things: list[int], divisor: int, stuff_area: int, void: int = 0, threshold: float = 0.1, kernel: int = 7
) -> DataFrame:
    """(y, x, pan) of maps (y, x, sem, ctr, oy, ox): centres, grouping and the merge with the classes in one."""
    held = materialize(thing_instances(maps, things, threshold, kernel), "panoptic")  # read by the vote and by the merge
    return panoptic.merge_panoptic(held, things, divisor, stuff_area, void)


def segment_images(
    pixels: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], things: list[int], divisor: int, stuff_area: int, threshold: float = 0.1, kernel: int = 7
) -> DataFrame:
    """(y, x, pan): a model over batches of pixels (it returns y, x, sem, ctr, oy, ox), then ``panoptic_segmentation``."""
    from runlattice.sources.volumes import predict

    maps = materialize(predict(pixels, model, "y long, x long, sem long, ctr double, oy double, ox double"), "maps")
    return panoptic_segmentation(maps, things, divisor, stuff_area, 0, threshold, kernel)


def panoptic_runs(pixels: DataFrame, label: str, classes: list[int], divisor: int, things: list[int], connected: bool = True) -> DataFrame:
    """(class_id, label, y, s, e): row runs of the panoptic labels of ``classes``.

    With ``connected`` the instances of thing classes are connected components (diagonals count), numbered within the
    class by their first pixel; labels without an instance number stay classes.
    """
    cls = F.floor(F.col(label) / divisor).cast("long")
    runs = raster.pixel_runs(pixels.where(cls.isin(classes)), label).withColumn("class_id", F.floor(F.col("label") / divisor).cast("long"))
    if not connected:
        return runs.select("class_id", "label", "y", "s", "e")
    runs = materialize(runs, "panoptic-runs")
    whole = materialize(raster.run_components(runs.where(F.col("class_id").isin(things)).select("class_id", "label", "y", "s", "e")), "panoptic-runs")
    named = objects.global_rank(whole.select("class_id", "component").distinct(), ["component"], ["class_id"], "_n")
    parts = whole.join(named, ["class_id", "component"]).withColumn("label", F.col("class_id") * divisor + F.col("_n"))
    stuff = runs.where(~F.col("class_id").isin(things))
    return parts.select("class_id", "label", "y", "s", "e").unionByName(stuff.select("class_id", "label", "y", "s", "e"))


def paint_runs(runs: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, pan): the dense image of row runs (class_id, label, y, s, e), 0 where there are none; of several the last by class and label."""
    grid = runs.sparkSession.range(height * width).select(F.floor(F.col("id") / width).alias("y"), F.pmod("id", F.lit(width)).alias("x"))
    points = intervals.decode(runs.select("class_id", "label", "y", "s", "e"), "x")
    top = points.groupBy("y", "x").agg(F.max(F.struct("class_id", "label"))["label"].alias("pan"))
    return grid.join(top, ["y", "x"], "left").select("y", "x", F.coalesce("pan", F.lit(0).cast("long")).alias("pan"))


def filter_things(runs: DataFrame, keys: list[str], things: list[int], extents: list, min_size: int = 200, min_extent: int = 4) -> DataFrame:
    """Runs (class_id, keys, s, e); objects of thing classes must be large and extended enough, the others all stay."""
    thing = F.col("class_id").isin(things)
    steps = [
        {"name": "remove_small_objects", "keys": keys, "min_size": min_size},
        {"name": "remove_pancakes", "keys": keys, "extents": extents, "min_span": min_extent},
    ]
    return objects.apply_filters(runs.where(thing), steps).unionByName(runs.where(~thing))


def stack_postprocessing(runs: DataFrame, things: list[int], extents: list, min_size: int = 200, min_extent: int = 4) -> DataFrame:
    """Runs of tracked objects (class_id, label, s, e, ...) with ``new_label``: numbered 1.. in each class by first position, then filtered.

    Numbers are given before the filters, so they may have gaps.
    """
    named = materialize(objects.relabel(runs, ["class_id"], "label"), "stack")
    return filter_things(named, ["class_id", "new_label"], things, extents, min_size, min_extent)


def tracker_consensus(
    runs: DataFrame, keys: list[str], width: int, n_sources: int, things: list[int], extents: list, votes: int = 2, least_iou: float = 0.75,
    one_view: bool = False, min_size: int = 200, min_extent: int = 4,
) -> DataFrame:
    """(class_id, instance, keys, s, e) of what several sources agree on; ``runs``: class_id, keys, node, source, s, e.

    Objects of thing classes by instance consensus and filters; other classes by votes, as instance 1.
    """
    thing = F.col("class_id").isin(things)
    by = ["class_id", *keys]
    found = consensus.instance_consensus(runs.where(thing), by, width, n_sources, votes, least_iou, one_view)
    found = filter_things(found, ["class_id", "instance"], things, extents, min_size, min_extent)
    flat = consensus.semantic_consensus(runs.where(~thing).select(*by, "s", "e"), by, votes).withColumn("instance", F.lit(1).cast("long"))
    cols = ["class_id", "instance", *keys, "s", "e"]
    return found.select(*cols).unionByName(flat.select(*cols))


def evaluate(truth: DataFrame, found: DataFrame, keys: list[str], width: int, least: float = 0.5) -> DataFrame:
    """One row for each class of either side: semantic iou and all of ``metrics.scores_of`` by the optimal matching.

    ``truth``, ``found``: class_id, keys, label, s, e; runs of one side's class may overlap (they count once for the
    semantic iou).  A class that one side lacks has iou 0.
    """
    by = ["class_id", *keys]
    sides = {x: df.select(*by, "label", "s", "e") for x, df in (("gt", truth), ("pred", found))}
    flat = {x: materialize(intervals.union(df, by), "evaluate") for x, df in sides.items()}
    inter = overlaps(flat["gt"], flat["pred"], by, width).groupBy("class_id").agg(F.sum("inter").cast("long").alias("i"))
    row = inter
    for x, df in flat.items():
        row = row.join(areas(df, ["class_id"]).withColumnRenamed("area", f"a_{x}"), "class_id", "full")
    for x, df in sides.items():
        row = row.join(df.groupBy("class_id").agg(F.countDistinct("label").alias(f"n_{x}")), "class_id", "left")
    pairs = _by_class(sides, by, width)
    ids = [(F.col("class_id") * LABELS + F.col(f"label_{x}")).alias(x) for x in "ab"]
    matched = match(pairs.select(*ids, F.col("iou").alias("score")), least)
    hits = matched.groupBy(F.floor(F.col("a") / LABELS).alias("class_id")).agg(F.count(F.lit(1)).alias("tp"), F.sum("score").alias("iou_sum"))
    row = row.join(hits, "class_id", "left").na.fill(0)
    iou = F.col("i") / (F.col("a_gt") + F.col("a_pred") - F.col("i"))
    return metrics.scores_of(row.withColumn("iou", iou), ["class_id", "iou"])


def _by_class(sides: dict[str, DataFrame], by: list[str], width: int) -> DataFrame:
    """(class_id, label_a, label_b, iou) of objects whose runs lie on rows or planes ``by``."""
    pairs = overlaps(sides["gt"], sides["pred"], by, width).groupBy("class_id", "label_a", "label_b").agg(F.sum("inter").cast("long").alias("inter"))
    for x, side in (("a", sides["gt"]), ("b", sides["pred"])):
        own = areas(side, ["class_id", "label"]).select("class_id", F.col("label").alias(f"label_{x}"), F.col("area").alias(f"area_{x}"))
        pairs = pairs.join(own, ["class_id", f"label_{x}"])
    return pairs.withColumn("iou", F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")))


def class_panoptic_quality(pixels: DataFrame, gt: str, pred: str, classes: list[int], divisor: int, least: float = 0.5) -> DataFrame:
    """(class_id, tp, fp, fn, pq) for each of ``classes``; 1 for a class without objects on either side.

    The mean IoU of the matches is their sum by tp + 1e-5.
    """
    table = materialize(metrics.contingency(pixels, gt, pred), "panoptic-quality")
    cls = lambda c: F.floor(F.col(c) / divisor).cast("long")
    pairs = metrics.pair_scores(table).where((cls("a") == cls("b")) & cls("a").isin(classes))
    matched = match(pairs.select("a", "b", "score"), least)
    hits = matched.groupBy(cls("a").alias("class_id")).agg(F.count(F.lit(1)).alias("tp"), F.sum("score").alias("_s"))
    row = pixels.sparkSession.createDataFrame([(c,) for c in classes], "class_id long").join(hits, "class_id", "left")
    for c in ("gt", "pred"):
        n = table.where(F.col(c) > 0).groupBy(cls(c).alias("class_id")).agg(F.countDistinct(c).alias(f"n_{c}"))
        row = row.join(n, "class_id", "left")
    row = row.na.fill(0).withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    quality = F.col("_s") / (F.col("tp") + metrics.EPS) * F.col("tp") / (F.col("tp") + F.col("fp") / 2 + F.col("fn") / 2)
    return row.select("class_id", "tp", "fp", "fn", F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(quality).alias("pq"))


def take(values: DataFrame, index: DataFrame, axis: str) -> DataFrame:
    """The rows of an array (its axes, value) at the places ``index`` (axis, place) along an axis, in the order of the index."""
    return values.join(index.select(axis, "place"), axis).drop(axis).withColumnRenamed("place", axis)


def put(values: DataFrame, index: DataFrame, axis: str, value: str, new) -> DataFrame:
    """An array with ``new`` at the places ``index`` (axis) along an axis."""
    hit = index.select(axis).distinct().withColumn("_hit", F.lit(True))
    out = values.join(hit, axis, "left")
    return out.withColumn(value, F.when(F.col("_hit"), new).otherwise(F.col(value))).drop("_hit")
