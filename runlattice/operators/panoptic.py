"""From the maps that a network predicts to panoptic labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlattice.operators.objects import global_rank
from runlattice.operators.raster import centers, nearest_center


def majority(pixels: DataFrame, of: str, value: str) -> DataFrame:
    """The most frequent value for each ``of``; ties go to the smallest value."""
    counted = pixels.groupBy(of, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(of).agg(best.alias("m")).select(of, F.col("m.v").alias(value))


def group_pixels(maps: DataFrame, threshold: float = 0.1, kernel: int = 7) -> DataFrame:
    """(y, x, ins): number of the centre nearest to where each pixel points; maps: (y, x, ctr, oy, ox)."""
    found = global_rank(centers(maps, "ctr", threshold, kernel).select("y", "x"), ["y", "x"], [], "center")
    points = found.select("center", F.col("y").alias("cy"), F.col("x").alias("cx"))
    to = nearest_center(maps.select("y", "x", "oy", "ox"), points, F.col("y") + F.col("oy"), F.col("x") + F.col("ox"))
    return to.select("y", "x", F.col("center").alias("ins"))


def merge_panoptic(pixels: DataFrame, things: list[int], divisor: int, stuff_area: int, void: int = 0) -> DataFrame:
    """(y, x, pan) of pixels (y, x, sem, ins): instances by majority class, numbered within it; then stuff of enough area."""
    is_thing = F.col("sem").isin(things)
    voted = majority(pixels.where((F.col("ins") > 0) & is_thing), "ins", "sem").withColumnRenamed("sem", "_class")
    numbered = global_rank(voted, ["ins"], ["_class"], "_n")
    stuff = pixels.where((F.col("ins") == 0) & ~is_thing).groupBy("sem").agg(F.count(F.lit(1)).alias("_area"))
    stuff = stuff.where(F.col("_area") >= stuff_area).select(F.col("sem").alias("_stuff"))
    out = pixels.join(numbered, "ins", "left").join(F.broadcast(stuff), F.col("sem") == F.col("_stuff"), "left")  # one row a class
    pan = F.when((F.col("ins") > 0) & is_thing & F.col("_n").isNotNull(), F.col("_class") * divisor + F.col("_n"))
    pan = pan.when((F.col("ins") == 0) & F.col("_stuff").isNotNull(), F.col("sem") * divisor).otherwise(void)
    return out.select("y", "x", pan.cast("long").alias("pan"))


def sample_weights(paths: DataFrame, gamma: float = 0.3) -> DataFrame:
    """Weights of examples: (1 / examples of the source) ** gamma, summing to 1 over the sources."""
    per = paths.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    raw = F.pow(1.0 / F.col("n"), gamma)
    total = per.agg(F.sum(raw).alias("_t"))
    return paths.join(per.join(F.broadcast(total)).select("source", (raw / F.col("_t")).alias("weight")), "source")


def norms(pixels: DataFrame, image: list[str], value: str) -> DataFrame:
    """Mean of the images' means and of their population deviations, both of 255."""
    per = pixels.groupBy(*image).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("d"))
    return per.agg((F.avg("m") / 255.0).alias("mean"), (F.avg("d") / 255.0).alias("std"))


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, more likely with more weight (exponential keys); ties have probability 0."""
    return rows.withColumn("_k", -F.log(F.rand(seed)) / F.col(weight)).orderBy("_k").limit(n).drop("_k")


def uncertain_points(logits: DataFrame, image: list[str], value: str, k: int) -> DataFrame:
    """The k points of each image whose logit is nearest to 0; ties by place."""
    order = W.partitionBy(*image).orderBy(F.abs(value), "y", "x")
    return logits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
