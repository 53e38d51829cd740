"""Scores of a segmentation against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.operators.assign import match
from runlattice.operators.objects import global_rank

EPS = 1e-5


def contingency(pixels: DataFrame, gt: str, pred: str) -> DataFrame:
    """(gt, pred, n): pixels by pair of labels."""
    return pixels.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def pair_scores(table: DataFrame) -> DataFrame:
    """(a, b, inter, score): IoU of labels above 0 that meet, from a contingency table."""
    na = table.groupBy(F.col("gt").alias("a")).agg(F.sum("n").alias("na"))
    nb = table.groupBy(F.col("pred").alias("b")).agg(F.sum("n").alias("nb"))
    met = table.where("gt > 0 and pred > 0").select(F.col("gt").alias("a"), F.col("pred").alias("b"), F.col("n").alias("inter"))
    met = met.join(na, "a").join(nb, "b")
    return met.select("a", "b", "inter", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("score"))


def counts(matched: DataFrame, n_gt: DataFrame, n_pred: DataFrame, least: float) -> DataFrame:
    """One row (n_gt, n_pred, n_matched, tp, iou_sum): from matched pairs (score) and one-row counts."""
    hits = matched.agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.sum((F.col("score") >= least).cast("long")).alias("tp"),
        F.sum(F.when(F.col("score") >= least, F.col("score"))).alias("iou_sum"),
    )
    return hits.na.fill(0).join(n_gt).join(n_pred)  # rows of totals


def scores_of(c: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, tp, fp, fn, precision, recall, f1, ap, mean_iou, pq; with nothing to find and nothing found, 1."""
    fp, fn, tp = F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp"), F.col("tp")
    empty = (F.col("n_gt") == 0) & (F.col("n_pred") == 0)
    share = lambda a, b: F.when(empty, 1.0).when(b > 0, a / b).otherwise(0.0)
    return c.select(
        *keys, tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"),
        share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("ap"),
        share(F.col("iou_sum"), tp).alias("mean_iou"),
        share(F.col("iou_sum"), tp + fp / 2 + fn / 2).alias("pq"),
    )


def instance_scores(pixels: DataFrame, gt: str, pred: str, least: float = 0.5) -> DataFrame:
    """All of ``scores_of`` for two labelled images, by the optimal matching."""
    table = materialize(contingency(pixels, gt, pred), "contingency")  # read five times
    matched = match(pair_scores(table).select("a", "b", "score"), least)
    n = lambda c: table.where(F.col(c) > 0).agg(F.countDistinct(c).alias(f"n_{c}"))
    return scores_of(counts(matched, n("gt"), n("pred"), least))


def pixel_scores(pixels: DataFrame, gt: Column, pred: Column) -> DataFrame:
    """accuracy, acc_0, acc_1, mean_iou, mean_dice of two binary images; nulls where a class is absent in both."""
    p = pixels.select(gt.cast("int").alias("g"), pred.cast("int").alias("p"))
    agg = p.agg(*[F.sum(((F.col("g") == a) & (F.col("p") == b)).cast("long")).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    same = {0: F.col("n00"), 1: F.col("n11")}
    off = F.col("n01") + F.col("n10")
    iou = {k: F.try_divide(same[k], same[k] + off) for k in same}
    dice = {k: F.try_divide(2 * same[k], 2 * same[k] + off) for k in same}
    mean = lambda d: F.aggregate(F.filter(F.array(d[0], d[1]), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x) / F.when(d[0].isNotNull() & d[1].isNotNull(), 2).otherwise(1)
    return agg.select(
        ((F.col("n00") + F.col("n11")) / (F.col("n00") + F.col("n11") + off)).alias("accuracy"),
        F.try_divide(F.col("n00"), F.col("n00") + F.col("n01")).alias("acc_0"), F.try_divide(F.col("n11"), F.col("n11") + F.col("n10")).alias("acc_1"),
        mean(iou).alias("mean_iou"), mean(dice).alias("mean_dice"),
    )


def class_iou(pixels: DataFrame, gt: Column, pred: Column) -> DataFrame:
    """One row iou: (intersection + eps) / (union + eps), 1 for two empty images."""
    both = F.sum((gt & pred).cast("long"))
    either = F.sum((gt | pred).cast("long"))
    return pixels.agg(((both + EPS) / (either + EPS)).alias("iou"))


def semantic_iou(scored: DataFrame, n_gt: DataFrame, n_pred: DataFrame) -> DataFrame:
    """One row iou from overlaps (inter) and areas: 1 if both are empty, 0 if one is."""
    inter = scored.agg(F.coalesce(F.sum("inter"), F.lit(0)).alias("i"))
    row = inter.join(n_gt).join(n_pred)
    union = F.col("gt") + F.col("pred") - F.col("i")
    return row.select(F.when(union == 0, 1.0).otherwise(F.col("i") / union).alias("iou"))


def running_mean(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return values.withColumn("mean", F.avg(value).over(w))


def ema(values: DataFrame, keys: list[str], order: str, value: str, momentum: float = 0.98) -> DataFrame:
    """(keys, n, ema): bias-corrected moving average at the end of each key's values, as a weighted sum.

    The weight of a value is the momentum to the number of values after it, so no value is folded after another.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order))) - 1
    weight = F.pow(F.lit(momentum), F.col("_k")) * (1 - momentum)
    out = values.withColumn("_k", place).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(weight * F.col(value)).alias("_s"))
    return out.select(*keys, "n", (F.col("_s") / (1 - F.pow(F.lit(momentum), F.col("n")))).alias("ema"))


def top_share_mean(losses: DataFrame, loss: str, share: float = 0.2) -> DataFrame:
    """One row: the mean of the largest ``share`` of the losses (whole rows, cut down).

    Losses are ranked by ranges, so no window runs over all of them; equal losses are as good as each other.
    """
    ranked = global_rank(losses.select((-F.col(loss)).alias("_l")), ["_l"], out="_r")
    k = losses.agg(F.floor(F.count(F.lit(1)) * share).alias("k"))  # one row
    return ranked.join(F.broadcast(k), F.col("_r") <= F.col("k")).agg((F.sum(-F.col("_l")) / F.max("k")).alias("loss"))


def mean_squared(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.avg((F.col(a) - F.col(b)) ** 2).alias("loss"))


def masked_l1(rows: DataFrame, pairs: list[tuple[str, str]], weight: str) -> DataFrame:
    """Sum of weighted absolute differences by the sum of weights; 0 where no weight is set."""
    diff = sum((F.abs(F.col(a) - F.col(b)) for a, b in pairs), F.lit(0.0))
    s = rows.agg(F.sum(diff * F.col(weight)).alias("s"), F.sum(weight).alias("w"))
    return s.select(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("loss"))


def object_overlaps(pixels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, iou, dice, ioa) of every pair of objects that share a pixel; ioa: of the object of ``a``."""
    n = pixels.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    area = lambda c, name: n.groupBy(c).agg(F.sum("_n").alias(name))
    both = n.where((F.col(a) > 0) & (F.col(b) > 0)).join(area(a, "_a"), a).join(area(b, "_b"), b)
    share, total = F.col("_n").cast("double"), F.col("_a") + F.col("_b")
    return both.select(a, b, (share / (total - F.col("_n"))).alias("iou"), (2.0 * share / total).alias("dice"), (share / F.col("_a")).alias("ioa"))
