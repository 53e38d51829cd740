"""Overlap joins: equality on keys and a grid cell, the overlap itself as a residual condition.

An interval enters every cell that it touches; a pair counts only in the cell of the larger start, so no
pair comes twice and no distinct is needed.  No plan here has a nested loop or a Cartesian product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _celled(df: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)
    return df.where(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(F.sequence(first, last)))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of runs that overlap, with ``inter``; columns of a and b but keys get suffixes _a and _b."""
    left, right = _suffixed(_celled(a, "s", "e", width), keys, "_a"), _suffixed(_celled(b, "s", "e", width), keys, "_b")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l._cell_a") == F.col("r._cell_b")]
    owner = F.floor(F.greatest("s_a", "s_b") / width) == F.col("l._cell_a")
    hit = (F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")) & owner
    pairs = left.alias("l").join(right.alias("r"), on).where(hit)
    inter = F.least("e_a", "e_b") - F.greatest("s_a", "s_b")
    cells = ("_cell_a", "_cell_b")
    return pairs.select(
        *[F.col(f"l.{k}") for k in keys],
        *[c for c in left.columns if c not in (*keys, *cells)],
        *[c for c in right.columns if c not in (*keys, *cells)],
        inter.alias("inter"),
    )


def _suffixed(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(c + suffix) for c in df.columns])


def areas(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("area"))


def scores(a: DataFrame, b: DataFrame, keys: list[str], ids: list[str], width: int) -> DataFrame:
    """(keys, ids_a, ids_b, inter, area_a, area_b, iou, ioa) of the objects of a and b that overlap; ioa is of b."""
    ends = [f"{i}{x}" for x in ("_a", "_b") for i in ids]
    pairs = overlaps(a.select(*keys, *ids, "s", "e"), b.select(*keys, *ids, "s", "e"), keys, width)
    pairs = pairs.groupBy(*keys, *ends).agg(F.sum("inter").cast("long").alias("inter"))
    for x, side in (("_a", a), ("_b", b)):
        own = areas(side, [*keys, *ids]).select(*keys, *[F.col(i).alias(i + x) for i in ids], F.col("area").alias("area" + x))
        pairs = pairs.join(own, [*keys, *[i + x for i in ids]])
    return pairs.withColumns(
        {
            "iou": F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")),
            "ioa": F.col("inter") / F.col("area_b"),
        }
    )


def box_overlaps(a: DataFrame, b: DataFrame, axes: list[tuple[str, str]], width: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs of boxes that overlap on all axes, with inter, iou; the grid lies on the first axis."""
    lo, hi = axes[0]
    left, right = _suffixed(_celled(a, lo, hi, width), keys, "_a"), _suffixed(_celled(b, lo, hi, width), keys, "_b")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l._cell_a") == F.col("r._cell_b")]
    pairs = left.alias("l").join(right.alias("r"), on)
    pairs = pairs.where(F.floor(F.greatest(lo + "_a", lo + "_b") / width) == F.col("l._cell_a"))
    inter, vol_a, vol_b = F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit(1).cast("long")
    for x, y in axes:
        side = F.least(y + "_a", y + "_b") - F.greatest(x + "_a", x + "_b")
        pairs = pairs.where(side > 0)
        inter, vol_a, vol_b = inter * side, vol_a * (F.col(y + "_a") - F.col(x + "_a")), vol_b * (F.col(y + "_b") - F.col(x + "_b"))
    keep = [F.col(f"l.{k}") for k in keys] + [c for c in left.columns + right.columns if c not in (*keys, "_cell_a", "_cell_b")]
    return pairs.select(*keep, inter.alias("inter"), (inter / (vol_a + vol_b - inter)).alias("iou"))


def best_match(edges: DataFrame, of: list[str], score: str, tie: list[str]) -> DataFrame:
    """The row with the largest score for each ``of``; ties go to the smallest ``tie``."""
    rest = [c for c in edges.columns if c not in of]
    order = F.struct((-F.col(score)).alias("_s"), *[F.col(t).alias(f"_{t}") for t in tie], F.struct(*rest).alias("_row"))
    return edges.groupBy(*of).agg(F.min(order).alias("_m")).select(*of, "_m._row.*")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: int = 64) -> DataFrame:
    """The pairs of a point (y, x, ...) and a box (y1, x1, y2, x2, ...; ends excluded) that holds it.

    A box enters the cells of the grid that it touches, so a point meets the boxes of its cell in one equality join.
    """
    spread = boxes
    for c, a, b in (("_cy", "y1", "y2"), ("_cx", "x1", "x2")):
        spread = spread.withColumn(c, F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))))
    own = points.withColumn("_cy", F.floor(F.col("y") / cell)).withColumn("_cx", F.floor(F.col("x") / cell))
    inside = (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")) & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2"))
    return own.join(spread, ["_cy", "_cx"]).where(inside).drop("_cy", "_cx")
