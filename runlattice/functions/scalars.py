"""Column expressions: run strings, boxes, coordinates, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs_to_string(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rle): "start run start run ..." in order of the starts; the runs of one object are gathered."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("s").alias("s"), (F.col("e") - F.col("s")).alias("r"))))
    parts = F.transform(listed, lambda x: F.concat_ws(" ", x["s"].cast("string"), x["r"].cast("string")))
    return runs.groupBy(*keys).agg(F.array_join(parts, " ").alias("rle"))


def string_to_runs(objects: DataFrame, keys: list[str], rle: str = "rle") -> DataFrame:
    """The runs of such strings; an empty string has none."""
    numbers = F.transform(F.filter(F.split(F.col(rle), " "), lambda x: x != ""), lambda x: x.cast("long"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_n") / 2).cast("int") - 1),
        lambda i: F.struct(F.get("_n", 2 * i).alias("s"), (F.get("_n", 2 * i) + F.get("_n", 2 * i + 1)).alias("e")),
    )
    some = objects.select(*keys, numbers.alias("_n")).where(F.size("_n") > 1)
    return some.select(*keys, F.inline(pairs))


def box_area(lows: list[str], highs: list[str]) -> Column:
    out = F.lit(1).cast("long")
    for a, b in zip(lows, highs):
        out = out * (F.col(b) - F.col(a))
    return out


def ravel(y: Column, x: Column, width: int, z: Column | None = None, height: int | None = None) -> Column:
    flat = y * width + x
    return flat if z is None else z * (height * width) + flat


def unravel(index: Column, width: int) -> tuple[Column, Column]:
    return F.floor(index / width), F.pmod(index, F.lit(width).cast("long"))


def pad_box(lows: list[str], highs: list[str], shape: list[int], by: int) -> list[Column]:
    """Bounds of a box grown by ``by`` and cut at the image."""
    lo = [F.greatest(F.col(c) - by, F.lit(0).cast("long")).alias(c) for c in lows]
    hi = [F.least(F.col(c) + by, F.lit(n).cast("long")).alias(c) for c, n in zip(highs, shape)]
    return lo + hi


def panoptic(label: Column, divisor: int) -> tuple[Column, Column]:
    """(class, instance) of a panoptic label."""
    return F.floor(label / divisor), F.pmod(label, F.lit(divisor).cast("long"))


def of_class(label: Column, class_id: int, divisor: int) -> Column:
    """The label where it belongs to the class, else 0."""
    return F.when((label >= class_id * divisor) & (label < (class_id + 1) * divisor), label).otherwise(0)


def normalize(v: Column, mean: float, std: float, top: float = 255.0) -> Column:
    return (v - mean * top) / (std * top)


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    top = F.array_max(logits)
    return F.transform(logits, lambda x: F.exp(x - top) / F.aggregate(logits, F.lit(0.0), lambda a, y: a + F.exp(y - top)))


def harden(probs: Column, threshold: float) -> Column:
    """Class of an array of probabilities: the largest, or a threshold where there is but one."""
    largest = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    return F.when(F.size(probs) > 1, largest).otherwise((F.get(probs, 0) >= threshold).cast("int"))


def smallest_unsigned(top: Column) -> Column:
    """Name of the smallest unsigned type that holds a value."""
    return F.when(top < 256, "uint8").when(top < 65536, "uint16").when(top < 4294967296, "uint32").otherwise("uint64")


def lift_box(axis: Column, z: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> list[Column]:
    """(z1, y1, x1, z2, y2, x2) of a box of a plane: xy has z, xz has y and yz has x as its index."""
    pick = lambda xy, xz, yz: F.when(axis == "xy", xy).when(axis == "xz", xz).otherwise(yz)
    return [
        pick(z, a1, a1).alias("z1"), pick(a1, z, b1).alias("y1"), pick(b1, b1, z).alias("x1"),
        pick(z + 1, a2, a2).alias("z2"), pick(a2, z + 1, b2).alias("y2"), pick(b2, b2, z + 1).alias("x2"),
    ]


def lift_point(axis: str, z: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(z, y, x) of a point (a, b) of plane z."""
    return {"xy": (z, a, b), "xz": (a, z, b), "yz": (a, b, z)}[axis]


def inside_polygon(y: Column, x: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether (y, x) lies in a polygon: edges crossed to the right of it, counted."""
    crossed = F.lit(False)
    for (y1, x1), (y2, x2) in zip(corners, corners[1:] + corners[:1]):
        if y1 == y2:
            continue
        between = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        crossed = crossed != (between & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1))
    return crossed


def square_around(y: Column, x: Column, size: int) -> list[Column]:
    """Corners (y1, x1, y2, x2) of the square around a centre, cut to whole numbers."""
    half = size / 2
    return [(c + d).cast("long").alias(n) for c, d, n in ((y, -half, "y1"), (x, -half, "x1"), (y, half, "y2"), (x, half, "x2"))]


def parse_classes(lines: DataFrame, text: str = "line") -> DataFrame:
    """(class_id, name, kind) of lines "id,name[,kind]"; lines without an id are left out."""
    part = F.split(F.col(text), r"\s*,\s*")
    out = lines.select(F.trim(F.get(part, 0)).try_cast("long").alias("class_id"), F.trim(F.get(part, 1)).alias("name"), F.trim(F.get(part, 2)).alias("kind"))
    return out.where(F.col("class_id").isNotNull())
