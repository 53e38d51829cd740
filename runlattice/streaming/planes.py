"""Structured Streaming over planes: labels carried forward as planes arrive, and running means."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runlattice.functions.storage import materialize, release
from runlattice.operators.graph import components
from runlattice.operators.joins import areas, overlaps
from runlattice.operators.objects import global_rank
from runlattice.operators.tracking import PlaneFold

PLANE = "class_id long, z long, label long, s long, e long"
TRACKED = "class_id long, z long, label long, track long"
#: What is carried from batch to batch: runs of the last plane by name; the last plane of a class and the next number for a name.
LAST, TOPS = "class_id long, t long, s long, e long", "class_id long, z long, next long"
#: Overlaps of a task; a component of them is never cut.
TASK_EDGES = 100_000


def read_planes(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of run tables, a Parquet file for each plane, in the order of their arrival."""
    return spark.readStream.schema(PLANE).option("maxFilesPerTrigger", files).parquet(path)


def _named(pdf: pd.DataFrame, least_iou: float, least_ioa: float) -> pd.DataFrame:
    """(class_id, label, t) of whole components of overlapping objects of two planes; t is null where nothing is carried on.

    Rows: (class_id, t, label, inter, size_t, size) of the overlaps of names t and labels.
    """
    out = []
    for c, rows in pdf.groupby("class_id", sort=True):
        fold = PlaneFold(False, least_iou, least_ioa)
        fold.area = dict(zip(rows.t.tolist(), rows.size_t.tolist()))
        fold.of = {t: t for t in fold.area}
        sizes = dict(zip(rows.label.tolist(), rows["size"].tolist()))
        names = fold._matched(sizes, list(zip(rows.t.tolist(), rows.label.tolist(), rows.inter.tolist())), dict.fromkeys(sizes))
        out += [(c, x, t) for x, t in names.items()]
    return pd.DataFrame(out, columns=["class_id", "label", "t"]).astype({"class_id": "int64", "label": "int64", "t": "Int64"})


def _carried_on(last: DataFrame, plane: DataFrame, sizes: DataFrame, width: int, least_iou: float, least_ioa: float) -> DataFrame:
    """(class_id, label, t): the objects of ``plane`` that take a name t of ``last`` (class_id, t, s, e); ``sizes``: their areas."""
    pairs = overlaps(last, plane.select("class_id", "label", "s", "e"), ["class_id"], width)
    edges = pairs.groupBy("class_id", F.col("t_a").alias("t"), F.col("label_b").alias("label")).agg(F.sum("inter").cast("long").alias("inter"))
    edges = materialize(edges, "stream-edges")
    told = edges
    for end, of, size, alone in (("t", areas(last, ["class_id", "t"]), "size_t", "_t"), ("label", sizes, "size", "_b")):
        one = edges.groupBy("class_id", end).agg((F.count(F.lit(1)) == 1).alias(alone))
        told = told.join(of.withColumnRenamed("area", size), ["class_id", end]).join(one, ["class_id", end])
    told = materialize(told, "stream-scores", drop=(edges,))
    # objects that meet one another only are told apart here; the others by component, many in a task
    iou, ioa = F.col("inter") / (F.col("size_t") + F.col("size") - F.col("inter")), F.col("inter") / F.col("size")
    plain = told.where(F.col("_t") & F.col("_b")).where((iou >= max(least_iou, 1e-300)) | (ioa >= least_ioa)).select("class_id", "label", "t")
    rest = told.where(~(F.col("_t") & F.col("_b"))).drop("_t", "_b")
    n = rest.count()
    if not n:
        return materialize(plain, "stream-named", drop=(told,))
    # equal hashes of different objects only put their components together
    ends = rest.select(F.xxhash64("class_id", "t", F.lit(0)).alias("u"), F.xxhash64("class_id", "label", F.lit(1)).alias("v"))
    comps = components(ends, "stream-components")
    keyed = rest.withColumn("id", F.xxhash64("class_id", "label", F.lit(1))).join(comps, "id")
    keyed = keyed.withColumn("_k", F.pmod(F.xxhash64("component"), F.lit(n // TASK_EDGES + 1))).drop("id", "component")
    found = keyed.groupBy("_k").applyInPandas(lambda pdf: _named(pdf, least_iou, least_ioa), "class_id long, label long, t long")
    return materialize(plain.unionByName(found.where("t is not null")), "stream-named", drop=(told, comps))


def _step(z: int, plane: DataFrame, last: DataFrame | None, tops: DataFrame | None, width: int, least_iou: float, least_ioa: float) -> tuple[DataFrame, DataFrame]:
    """(class_id, label, track, z) of the objects of plane z, and (class_id, z, next): where the classes are after it."""
    sizes = areas(plane, ["class_id", "label"])
    if tops is None:
        tops = plane.sparkSession.createDataFrame([], TOPS)
    classes = plane.groupBy("class_id").agg(F.max("label").alias("most"))
    state = classes.join(tops, "class_id", "full")  # a row for each class
    gap = state.where((F.col("most").isNotNull()) & (F.col("z") + 1 != z)).first()
    if gap:
        raise ValueError(f"plane {z} after plane {gap.z}")
    if last is None:
        named = sizes.select("class_id", "label", F.lit(None).cast("long").alias("t"))
    else:
        carried = _carried_on(last, plane, sizes, width, least_iou, least_ioa)
        named = sizes.join(carried, ["class_id", "label"], "left").select("class_id", "label", "t")
    # a class keeps the labels of its first plane; what is new later gets the next numbers in the order of labels
    old = tops.select("class_id", "next")
    fresh = materialize(named.where("t is null").join(F.broadcast(old), "class_id"), "stream-new")
    ranked = global_rank(fresh.select("class_id", "label", "next"), ["label"], ["class_id"], "n")
    ranked = ranked.select("class_id", "label", (F.col("next") + F.col("n") - 1).alias("fresh"))
    out = named.join(ranked, ["class_id", "label"], "left")
    out = out.select("class_id", F.lit(z).cast("long").alias("z"), "label", F.coalesce("t", "fresh", "label").alias("track"))
    counts = fresh.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    after = F.when(F.col("most").isNull(), F.col("next")).when(F.col("next").isNull(), F.greatest(F.lit(1), F.col("most") + 1)).otherwise(F.col("next") + F.coalesce("n", F.lit(0)))
    at = F.when(F.col("most").isNull(), F.col("z")).otherwise(F.lit(z))
    state = state.join(counts, "class_id", "left").select("class_id", at.cast("long").alias("z"), after.cast("long").alias("next"))
    return out, state


def track_forward(planes: DataFrame, path: str, least_iou: float = 0.25, least_ioa: float = 0.25, width: int = 4096) -> DataStreamWriter:
    """A writer that names the objects of planes as they arrive; ``tracked`` reads (class_id, z, label, track) from ``path``.

    What is carried from plane to plane, the runs of the last plane by name and a row for each class, lies in the shared folder
    ``path``, so a plane is matched by joins in all executors however many objects it has.  A batch that is run again
    starts from what the batch before it left.  Planes must come in the order of z without gaps; anything else fails, as names would be wrong.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = materialize(rows.select("class_id", "z", "label", "s", "e"), "stream-batch")
        last = tops = None
        if number:
            last, tops = spark.read.schema(LAST).parquet(f"{path}/last/{number - 1}"), spark.read.schema(TOPS).parquet(f"{path}/tops/{number - 1}")
        zs = sorted(r.z for r in rows.select("z").distinct().collect())
        for z in zs:
            plane = rows.where(F.col("z") == z)
            out, state = _step(z, plane, last, tops, width, least_iou, least_ioa)
            place = f"{path}/out/batch={number}/plane={z}"
            out.write.mode("overwrite").parquet(place)
            names = spark.read.schema(TRACKED).parquet(place).select("class_id", "label", "track")
            carried = plane.join(names, ["class_id", "label"]).select("class_id", F.col("track").alias("t"), "s", "e")
            if last is not None:  # of classes that this plane doesn't have
                carried = carried.unionByName(last.join(F.broadcast(plane.select("class_id").distinct()), "class_id", "left_anti"))
            before = last, tops
            if z == zs[-1]:
                carried.write.mode("overwrite").parquet(f"{path}/last/{number}")
                state.coalesce(1).write.mode("overwrite").parquet(f"{path}/tops/{number}")
            else:
                last, tops = materialize(carried, "stream-last"), materialize(state, "stream-tops")
                release(*before)
        release(rows, last, tops)

    return planes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/state")


def tracked(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, z, label, track) that ``track_forward`` has written so far."""
    return spark.read.schema(f"{TRACKED}, batch long, plane long").parquet(f"{path}/out").select("class_id", "z", "label", "track")


def running_ema(values: DataFrame, momentum: float = 0.98) -> DataFrame:
    """(name, n, ema) of a stream (name, i, value): bias-corrected moving averages, updated with every batch."""

    def step(key, frames, state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(frames)).sort_values("i").value:
            total = momentum * total + (1 - momentum) * float(v)
            n += 1
        state.update((n, total))
        yield pd.DataFrame([(key[0], n, total / (1 - momentum**n))], columns=["name", "n", "ema"])

    return values.groupBy("name").applyInPandasWithState(step, "name string, n long, ema double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
