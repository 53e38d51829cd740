"""Workflows against brute force or what was planted."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlattice.functions import storage
from runlattice.operators import consensus, metrics, objects, raster, tiles, workflows
from runlattice.sources import trackers


@pytest.mark.parametrize("n", [0, 1, 5])
def test_nearest_centre_however_far(spark, n):
    random.seed(n)
    pixels = [(i, random.randrange(5000), random.randrange(5000)) for i in range(60)]
    points = [(k, random.randrange(5000), random.randrange(300)) for k in range(n)]
    df = spark.createDataFrame(pixels, "i long, y long, x long")
    got = raster.nearest_center(df, spark.createDataFrame(points, "center long, cy long, cx long"), F.col("y"), F.col("x"), cell=16)
    best = {i: min(((y - cy) ** 2 + (x - cx) ** 2, c) for c, cy, cx in points)[1] if points else None for i, y, x in pixels}
    assert {r.i: r.center for r in got.collect()} == best


def test_crops_meet_in_cells(spark):
    runs = spark.createDataFrame([(y, 7, y * 100 + 10, y * 100 + 60) for y in range(40)], "y long, label long, s long, e long")
    grid = tiles.tile_table(spark, 40, 100, 32, 8)
    got = tiles.crop_runs(runs, grid, 100, cell=16)
    expected = []
    for t in grid.collect():
        for y in range(t.ys, min(t.ye, 40)):
            lo, hi = max(10, t.xs), min(60, t.xe)
            if lo < hi:
                w = t.xe - t.xs
                expected.append((t.tile, 7, (y - t.ys) * w + lo - t.xs, (y - t.ys) * w + hi - t.xs))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_objects_of_one_tile_in_a_zone_go(spark):
    # 1 and 2 overlap across tiles; 3 lies in the zone in one tile only; 4 lies outside
    rows = [(0, 1, 0, 90, 110), (0, 2, 1, 95, 120), (1, 3, 0, 100, 110), (2, 4, 0, 10, 30)]
    runs = spark.createDataFrame(rows, "y long, node long, source long, s long, e long")
    zones = spark.createDataFrame([(y, 96, 112) for y in range(3)], "y long, s long, e long")
    got = consensus.merge_tiles(runs, ["y"], 64, zones)
    assert sorted(tuple(r) for r in got.select("instance", "s", "e").collect()) == [(1, 90, 120), (4, 10, 30)]


def test_classes_that_one_side_lacks(spark):
    kind = "class_id long, y long, label long, s long, e long"
    truth = spark.createDataFrame([(1, 0, 5, 0, 10), (2, 0, 6, 20, 30)], kind)
    found = spark.createDataFrame([(1, 0, 8, 0, 9), (3, 0, 9, 40, 50)], kind)
    got = {r.class_id: (round(r.iou, 9), r.tp, r.fp, r.fn) for r in workflows.evaluate(truth, found, ["y"], 64).collect()}
    assert got == {1: (0.9, 1, 0, 0), 2: (0.0, 0, 0, 1), 3: (0.0, 0, 1, 0)}


def test_views_agree_on_things_and_vote_on_stuff(spark):
    kind = "class_id long, y long, node long, source long, s long, e long"
    thing = [(1, y, 10 + v, v, 5 + v, 60) for y in range(6) for v in range(3)]
    small = [(1, 9, 20 + v, v, 100, 104) for v in range(3)]
    lone = [(1, y, 30, 0, 300, 390) for y in range(6)]
    stuff = [(2, 0, 40, 0, 0, 50), (2, 0, 41, 1, 40, 70)]
    runs = spark.createDataFrame(thing + small + lone + stuff, kind)
    got = workflows.tracker_consensus(runs, ["y"], 64, 3, [1], [(F.col("y"), F.col("y") + 1)], min_size=200)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, y, 6, 60) for y in range(6)] + [(2, 1, 0, 40, 50)]


def test_mean_of_the_largest_losses(spark):
    random.seed(1)
    values = [random.choice([0.5, random.random()]) for _ in range(503)]
    got = metrics.top_share_mean(spark.createDataFrame([(v,) for v in values], "v double"), "v", 0.2).first().loss
    assert got == pytest.approx(sum(sorted(values)[-100:]) / 100)


def test_parts_of_an_instance_become_instances(spark):
    image = ["11022", "11000", "00011", "33011"]
    rows = [(y, x, 100 + int(c) if c in "12" else 200 if c == "3" else 0) for y, line in enumerate(image) for x, c in enumerate(line)]
    got = workflows.panoptic_runs(spark.createDataFrame(rows, "y long, x long, gt long"), "gt", [1, 2], 100, [1])
    expected = [(1, 101, 0, 0, 2), (1, 101, 1, 0, 2), (1, 102, 0, 3, 5), (1, 103, 2, 3, 5), (1, 103, 3, 3, 5), (2, 200, 3, 0, 2)]
    assert sorted(tuple(r) for r in got.collect()) == expected
    back = workflows.paint_runs(got, 4, 5).collect()
    assert {(r.y, r.x) for r in back if r.pan} == {(y, x) for y, x, v in rows if v} and len(back) == 20


def test_nearest_centres_are_listed_not_paired(spark, monkeypatch):
    rng = np.random.default_rng(4)
    near, far = rng.integers(0, 60, (80, 2)).tolist(), [[900, 1000], [3000, 5]]
    points = [(k, y, x) for k, (y, x) in enumerate(near + far)]
    places = [(y, x) for y in range(0, 60, 4) for x in range(0, 60, 4)] + [(2500, 2500), (-700, 40), (950, 1010)]
    expected = {p: min(((cy - p[0]) ** 2 + (cx - p[1]) ** 2, k) for k, cy, cx in points)[1] for p in places}
    plans = []

    def held(df, name, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.materialize(df, name, **more)

    monkeypatch.setattr(raster, "materialize", held)
    pixels = spark.createDataFrame(places, "y long, x long")
    centres = spark.createDataFrame(points, "center long, cy long, cx long")
    for listed in (4096, 3):  # in one list and in several
        got = [((r.y, r.x), r.center) for r in raster.nearest_center(pixels, centres, F.col("y"), F.col("x"), listed=listed).collect()]
        assert len(got) == len(places) and dict(got) == expected
    assert "SortAggregate" not in plans[0]


def test_large_trackers_are_dealt_over_documents_and_read_back(spark):
    runs = [(c, k, y, y * 100 + s, y * 100 + s + 5) for c in (1, None) for k in range(40) for y in range(3) for s in (k, k + 7)]
    df = spark.createDataFrame(runs, "class_id long, label long, y long, s long, e long")
    rows = trackers.instance_rows(df.where("class_id = 1"), objects.run_boxes(df, ["class_id", "label"], 100), ["class_id", "label"], ["y1", "x1", "y2", "x2"])
    rows = rows.unionByName(rows.withColumn("class_id", F.lit(None).cast("long")))
    one = trackers.to_documents(rows, ["class_id"], "label", 1000, [1, 3, 100], "xy").where("class_id = 1").collect()
    assert len(one) == 1 and len(json.loads(one[0].json)["instances"]) == 40
    several = trackers.to_documents(rows, ["class_id"], "label", 1000, [1, 3, 100], "xy", part_bytes=1000)
    docs = [json.loads(r.json) for r in several.where("class_id = 1").collect()]
    assert len(docs) > 2 and all(d["class_id"] == 1 and d["label_divisor"] == 1000 for d in docs)
    assert sorted(int(k) for d in docs for k in d["instances"]) == list(range(40))
    read = trackers.from_documents(several.select(F.coalesce("class_id", F.lit(0).cast("long")).alias("path"), "json"), ["path"])
    got = sorted((r.path, r.label, r.s, r.e) for r in read.collect())
    assert got == sorted((c or 0, k, s, e) for c, k, _, s, e in runs)
    # no document goes along with its instances
    text = trackers.from_documents(spark.createDataFrame([("a", "{}")], "path string, json string"), ["path"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(" in text and "t#" not in text[text.index("Generate explode(") :].split("\n")[0].split("[", 1)[1]


def test_instance_scores_read_the_pixels_once(spark):
    rows = [(y, x, 1 + x // 8, 1 + (x + 1) // 8) for y in range(8) for x in range(32)]
    read = spark.sparkContext.accumulator(0)

    def counted(it):
        for pdf in it:
            read.add(len(pdf))
            yield pdf

    kind = "y long, x long, gt long, pred long"
    got = metrics.instance_scores(spark.createDataFrame(rows, kind).mapInPandas(counted, kind), "gt", "pred").collect()
    assert len(got) == 1 and (got[0].tp, got[0].fp, got[0].fn) == (4, 1, 0)
    assert read.value == len(rows)
