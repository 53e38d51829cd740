"""Objects of a segmentation: sizes, boxes, filters, labels."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize


def run_boxes(runs: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Size and box of each object of row-split runs."""
    x = F.col("s") - F.col("y") * width
    return runs.groupBy(*keys).agg(
        F.sum(F.col("e") - F.col("s")).cast("long").alias("area"),
        F.min("y").alias("y1"), F.min(x).alias("x1"), (F.max("y") + 1).alias("y2"), F.max(F.col("e") - F.col("y") * width).alias("x2"),
    )


def region_props(pixels: DataFrame, label: str) -> DataFrame:
    """Area, box and centroid of each label above 0."""
    return pixels.where(F.col(label) > 0).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("area"),
        F.min("y").alias("y1"), F.min("x").alias("x1"), (F.max("y") + 1).alias("y2"), (F.max("x") + 1).alias("x2"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"),
    )


def keep_objects(runs: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    return runs.join(good.select(*keys), keys, "left_semi")


def remove_small(runs: DataFrame, keys: list[str], min_size: int = 64) -> DataFrame:
    """Objects of at least ``min_size`` positions."""
    size = runs.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("n")).where(F.col("n") >= min_size)
    return keep_objects(runs, size, keys)


def remove_pancakes(runs: DataFrame, keys: list[str], extents: list[tuple[Column, Column]], min_span: int = 4) -> DataFrame:
    """Objects that span at least ``min_span`` on each axis; ``extents``: low and high of a run by axis."""
    spans = [(F.max(hi) - F.min(lo)).alias(f"_d{i}") for i, (lo, hi) in enumerate(extents)]
    wide = runs.groupBy(*keys).agg(*spans)
    least = F.least(*[f"_d{i}" for i in range(len(extents))]) if len(extents) > 1 else F.col("_d0")
    return keep_objects(runs, wide.where(least >= min_span), keys)


#: Filters by name, for pipelines that are given as data.
FILTERS = {"remove_small_objects": remove_small, "remove_pancakes": remove_pancakes}


def apply_filters(runs: DataFrame, steps: list[dict]) -> DataFrame:
    """Filters one after the other, each {"name": ..., other arguments}."""
    one = lambda df, step: FILTERS[step["name"]](df, **{k: v for k, v in step.items() if k != "name"})
    return functools.reduce(one, steps, runs)


def drop_small_areas(pixels: DataFrame, label: str, max_area: int) -> DataFrame:
    """Pixels of labels with more than ``max_area`` pixels (the bound itself is removed)."""
    small = pixels.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= max_area) & (F.col(label) > 0))
    return pixels.join(small.select(label), label, "left_anti")


def drop_boundary(pixels: DataFrame, label: str, sizes: dict[str, int]) -> DataFrame:
    """Pixels of labels that don't touch the border; ``sizes``: length of each axis."""
    edge = functools.reduce(lambda a, b: a | b, [(F.col(c) == 0) | (F.col(c) == n - 1) for c, n in sizes.items()])
    return pixels.join(pixels.where(edge & (F.col(label) > 0)).select(label).distinct(), label, "left_anti")


def delete_labels(pixels: DataFrame, label: str, gone: list[int], plane: tuple[str, int] | None = None) -> DataFrame:
    """Pixels with the labels set to 0, on one plane or everywhere."""
    hit = F.col(label).isin(gone)
    if plane:
        hit = hit & (F.col(plane[0]) == plane[1])
    return pixels.withColumn(label, F.when(hit, 0).otherwise(F.col(label)).cast("long"))


def merge_labels(pixels: DataFrame, label: str, points: DataFrame, into: int | None = None) -> DataFrame:
    """All labels under ``points`` (y, x) as one: ``into`` or the smallest of them."""
    picked = pixels.join(points, ["y", "x"]).where(F.col(label) > 0).select(F.col(label).alias("_l")).distinct()
    to = F.lit(into).cast("long") if into is not None else F.col("_to")
    target = picked.agg(F.min("_l").alias("_to"))
    joined = pixels.join(F.broadcast(picked), F.col(label) == F.col("_l"), "left").join(F.broadcast(target))  # as many rows as points
    return joined.withColumn(label, F.when(F.col("_l").isNotNull(), to).otherwise(F.col(label))).drop("_l", "_to")


def count_labels(labels: DataFrame, label: str, divisor: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Distinct labels above 0 of each class (label div divisor; divisor 0: one class)."""
    cls = F.floor(F.col(label) / divisor) if divisor else F.lit(1).cast("long")
    distinct = labels.where(F.col(label) > 0).select(*keys, F.col(label)).distinct()
    return distinct.groupBy(*keys, cls.alias("class_id")).agg(F.count(F.lit(1)).alias("n"))


def next_label(labels: DataFrame, label: str, class_id: int, divisor: int) -> DataFrame:
    """The smallest free label of a class: one row, null if none is free.

    The first free label follows a used one (or is the first of the class), so no range is generated.
    """
    first, end = class_id * divisor + 1, (class_id + 1) * divisor
    used = labels.where(F.col(label).between(first, end - 1)).select(F.col(label).alias("l")).distinct()
    start = labels.sparkSession.createDataFrame([(first,)], "l long")
    after = used.select((F.col("l") + 1).alias("l")).unionByName(start).where(F.col("l") < end)
    return after.join(used, "l", "left_anti").agg(F.min("l").alias("next_label"))


def global_rank(keys: DataFrame, order: list[str], within: list[str] = [], out: str = "rank", slices: int | None = None) -> DataFrame:  # noqa: B006
    """Rows with their place (from 1) in the order, within each ``within``, without a window over all rows.

    Rows are range-partitioned by (within, order); a partition's offset comes from the counts of those before it.
    """
    spark = keys.sparkSession
    by = [*within, *order]
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(n, *by).withColumn("_p", F.spark_partition_id())
    placed = materialize(placed, "rank")  # so that partitions are cut once
    counts = placed.groupBy(*within, "_p").agg(F.count(F.lit(1)).alias("_n"))
    side = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    before = side.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select(*within, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(W.partitionBy(*within, "_p").orderBy(*order))
    return placed.join(offset, [*within, "_p"]).withColumn(out, (inside + F.col("_o")).cast("long")).drop("_p", "_o")


def relabel(runs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Labels numbered 1..n in the order of their first position, within ``keys``."""
    first = runs.groupBy(*keys, label).agg(F.min("s").alias("_first"))
    ranks = global_rank(first, ["_first", label], keys, "new_label").drop("_first")
    return runs.join(ranks, [*keys, label])


def areas_report(runs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label, area, place): objects by area, the largest first, ties to the lower label."""
    area = runs.groupBy(*keys, label).agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("area"))
    return area.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("area").desc(), label)).cast("long"))


def first_places(runs: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """(keys, place): where each object begins, the least of the columns ``place``."""
    first = runs.groupBy(*keys).agg(F.min(F.struct(*place)).alias("_p"))
    return first.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in place])
