import numpy as np
import pytest
from pyspark.sql import functions as F

from runlattice.operators import flood, metrics, objects, raster, tiles, tracking
from runlattice.sources import volumes


def test_labels_follow_objects_through_planes(spark):
    rows = [
        (1, 1, 0, 10), (1, 2, 20, 30),
        (2, 1, 21, 31), (2, 2, 1, 11),
        # plane 3 is empty: what comes then is new
        (4, 1, 0, 10),
        (5, 1, 0, 4), (5, 2, 4, 10),
    ]
    df = spark.createDataFrame(rows, "z long, label long, s long, e long").withColumn("c", F.lit(1))
    got = {(r.z, r.label): r.track for r in tracking.track(df, ["c"], 64, backward=False).collect()}
    assert got[1, 1] == 1 and got[1, 2] == 2
    assert got[2, 1] == 2 and got[2, 2] == 1
    assert got[4, 1] == 3
    # two pieces of one object: one is matched, the other absorbed
    assert got[5, 1] == got[5, 2] == 3


def _tracks_by_one_fold(rows, least=0.25):
    """{(z, label): track} as one fold over the whole stack gives it."""
    planes = {z: [(x, s, e) for k, x, s, e in rows if k == z] for z in range(min(r[0] for r in rows), max(r[0] for r in rows) + 1)}
    size = {z: {x: sum(e - s for y, s, e in p if y == x) for x, _, _ in p} for z, p in planes.items()}

    def meet(a, b):
        met = {}
        for x, s, e in a:
            for y, t, f in b:
                if min(e, f) > max(s, t):
                    met[x, y] = met.get((x, y), 0) + min(e, f) - max(s, t)
        return [(x, y, n) for (x, y), n in met.items()]

    go, back = tracking.PlaneFold(True, least, least), tracking.PlaneFold(False, least, least)
    names = {z: go.step(z, size[z], meet(planes.get(z - 1, []), p)) for z, p in planes.items()}
    for z in sorted(planes, reverse=True):
        names[z] = back.step(z, size[z], meet(planes.get(z + 1, []), planes[z]), names[z])
    return {(z, x): t for z, of in names.items() for x, t in of.items()}


def test_a_stack_is_tracked_by_components_as_by_one_fold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for z in [2, 3, 4, 6, 7, 8]:
        at = 0
        for label in rng.permutation(np.arange(1, 31)).tolist():
            at += int(rng.choice([0, 0, 1, 5, 20]))
            n = int(rng.choice([2, 3, 5, 10]))
            rows.append((z, label, at, at + n))
            at += n
    df = spark.createDataFrame(rows, "z long, label long, s long, e long").withColumn("c", F.lit(1))
    got = {(r.z, r.label): r.track for r in tracking.track(df, ["c"], 16, task_rows=40).collect()}
    assert got == _tracks_by_one_fold(rows)


def test_no_task_of_tracking_holds_a_whole_stack(spark, monkeypatch):
    # 60 objects on 4 planes that meet nothing but themselves
    rows = [(z, x, x * 100 + z, x * 100 + z + 50) for z in range(4) for x in range(1, 61)]
    df = spark.createDataFrame(rows, "z long, label long, s long, e long").withColumn("c", F.lit(1))
    fold = tracking._fold_rows

    def bounded(pdf, *args):
        if len(pdf) > 200:  # of 420 areas and edges
            raise ValueError(f"{len(pdf)} rows in a task")
        return fold(pdf, *args)

    monkeypatch.setattr(tracking, "_fold_rows", bounded)
    got = {(r.z, r.label): r.track for r in tracking.track(df, ["c"], 64, task_rows=60).collect()}
    assert got == {(z, x): x for z in range(4) for x in range(1, 61)}


def test_recursive_median_replaces_what_it_has_passed(spark):
    df = spark.createDataFrame([([0, 9, 0, 9, 0, 9, 0],), ([5, 1],), ([1, 7, 2],)], "v array<long>")
    got = [list(r.m) for r in df.select(tracking.recursive_median(F.col("v"), 3).alias("m")).collect()]
    assert got == [[0] * 7, [5, 1], [1, 2, 2]]


def image(spark, a, name="v"):
    return spark.createDataFrame([(y, x, int(v)) for (y, x), v in np.ndenumerate(a)], f"y long, x long, {name} long")


def dense(df, shape, name):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def test_holes_are_filled_and_bays_are_not(spark):
    a = np.array([[1, 1, 1, 0, 2, 2, 2], [1, 0, 1, 0, 2, 0, 0], [1, 1, 1, 0, 2, 2, 2]])
    got = dense(raster.fill_holes(image(spark, a), "v"), a.shape, "v")
    expected = a.copy()
    expected[1, 1] = 1
    assert (got == expected).all()


def test_connected_pixels_with_and_without_diagonals(spark):
    a = np.array([[1, 0, 1], [0, 1, 0], [2, 2, 1]])
    n = lambda diagonal: raster.connected_pixels(image(spark, a), "v", diagonal).select("component").distinct().count()
    assert (n(True), n(False)) == (2, 5)


def test_flood_takes_the_nearest_marker(spark):
    mask = image(spark, np.ones((1, 9))).select("y", "x")
    marks = spark.createDataFrame([(0, 0, 5), (0, 8, 7)], "y long, x long, label long")
    got = dense(flood.flood(mask, marks), (1, 9), "label")
    assert got.tolist() == [[5, 5, 5, 5, 5, 7, 7, 7, 7]]


def test_tiles_cover_and_overlap():
    for length, size, overlap in ((4160, 512, 64), (100, 512, 64), (513, 512, 64), (2000, 700, 128)):
        r = tiles.axis_ranges(length, size, overlap)
        assert r[0][0] == 0 and r[-1][1] == length
        assert all(b[0] < a[1] and a[1] - b[0] >= overlap for a, b in zip(r, r[1:]))


def test_global_rank_is_dense_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), (F.col("id") % 3).alias("g"))
    got = sorted((r.g, r["rank"], r.v) for r in objects.global_rank(df, ["v"], ["g"]).collect())
    for g in range(3):
        own = [(k, v) for h, k, v in got if h == g]
        assert [k for k, _ in own] == list(range(1, len(own) + 1))
        assert [v for _, v in own] == sorted(v for _, v in own)


def test_scores_of_empty_images_are_one(spark):
    got = metrics.instance_scores(image(spark, np.zeros((2, 2)), "gt").withColumn("pred", F.lit(0)), "gt", "pred").first()
    assert (got.tp, got.fp, got.fn, got.f1, got.pq) == (0, 0, 0, 1.0, 1.0)


def test_next_label(spark):
    df = spark.createDataFrame([(1001,), (1002,), (1004,)], "l long")
    assert objects.next_label(df, "l", 1, 1000).first()[0] == 1003
    assert objects.next_label(df, "l", 2, 1000).first()[0] == 2001
    assert objects.next_label(spark.createDataFrame([(3,), (4,), (5,)], "l long"), "l", 1, 2).first()[0] is None


def test_image_pairs_and_tiles_round_trip(spark, tmp_path):
    for kind, add in (("images", 0), ("masks", 100)):
        for source in ("a", "b"):
            d = tmp_path / source / kind
            d.mkdir(parents=True)
            np.save(d / "one.npy", np.arange(6).reshape(2, 3) + add)
    pairs = volumes.image_pairs(spark, str(tmp_path))
    assert sorted((r.source, r.stem) for r in pairs.collect()) == [("a", "one"), ("b", "one")]
    px = volumes.decode_images(pairs.select("source", "image"), "image", ["source"])
    assert px.where("source = 'a'").agg(F.sum("v")).first()[0] == 15
    cut = tiles.cut_patches(px.where("source = 'a'").select("y", "x", "v"), 2)
    volumes.write_tiles(cut.drop("y", "x"), str(tmp_path / "tiles"), 2, 2, 3)
    back, meta = volumes.read_tiles(spark, str(tmp_path / "tiles"))
    whole = tiles.join_patches(back, meta["size"], meta["height"], meta["width"])
    assert sorted((r.y, r.x, r.v) for r in whole.collect()) == [(y, x, 3 * y + x) for y in range(2) for x in range(3)]


def test_config_inheritance():
    configs = {"base": {"a": 1, "n": {"x": 1, "y": 2}}, "child": {"BASE": "base", "n": {"y": 3}}}
    assert volumes.resolve_config(configs, "child") == {"a": 1, "n": {"x": 1, "y": 3}}


def test_stream_names_planes_as_the_batch_does(spark):
    from runlattice.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["stream_track"](spark, sf)
    assert got.count() == QUERIES["track_stack"](spark, sf).count()
    planes = QUERIES["lift_xy"](spark, sf)
    assert got.select("track").distinct().count() <= planes.count()
    assert got.groupBy("z", "label").count().where("count > 1").count() == 0


@pytest.mark.parametrize("name", ["instance_consensus", "consensus_core"])
def test_consensus_objects_lie_within_the_views(spark, name):
    from runlattice.plans.catalog import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 100


def test_a_stream_tracks_every_plane(spark):
    from runlattice.plans import catalog

    planes = spark.createDataFrame([(z, z * 10, 100 + z, 140 + z) for z in range(10)], "z long, label long, s long, e long")
    got = sorted((r.z, r.label, r.track) for r in catalog.stream_track(planes).collect())
    assert got == [(z, z * 10, 0) for z in range(10)]


def test_filled_volumes_show_the_last_object_and_no_position_is_shuffled(spark):
    rng = np.random.default_rng(3)
    rows = [(int(v), i, s, s + int(n)) for i, (v, s, n) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(-5000, 12000, 300).tolist(), rng.choice([1, 7, 60, 9000], 300)))]
    df = spark.createDataFrame(rows, "view long, label long, s long, e long")
    expected = {}
    for _, label, s, e in sorted(rows):
        expected |= dict.fromkeys(range(s, e), label)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # cells go on from batch to batch
    try:
        out = volumes.fill(df, "label", ["view", "label"])
        got = [(r.idx, r.label) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(expected) and dict(got) == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence(") < plan.index("Exchange")


def _planes(seed: int, classes: int, depth: int) -> list[tuple]:
    """Disjoint runs whose objects split, merge, come and go: (class_id, z, label, s, e)."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(classes):
        for z in range(depth):
            cuts = np.sort(rng.choice(np.arange(1, 400), 24, replace=False)).tolist()
            labels = rng.choice(np.arange(3, 40), 14, replace=False).tolist()
            rows += [(c, z, labels[rng.integers(0, 14)], int(s), int(e)) for s, e in zip(cuts[::2], cuts[1::2])]
    return rows


def _folded(rows: list[tuple]) -> list[tuple]:
    """(class_id, z, label, track) by the plain rule, plane by plane, with overlaps of every two runs."""
    from runlattice.operators.tracking import PlaneFold

    out = []
    for c in sorted({r[0] for r in rows}):
        fold, last = PlaneFold(), []
        for z in sorted({r[1] for r in rows if r[0] == c}):
            plane = [r[2:] for r in rows if r[:2] == (c, z)]
            sizes: dict = {}
            for x, s, e in plane:
                sizes[x] = sizes.get(x, 0) + e - s
            edges = [(a, b, min(ea, eb) - max(sa, sb)) for a, sa, ea in last for b, sb, eb in plane if min(ea, eb) > max(sa, sb)]
            out += [(c, z, x, t) for x, t in fold.step(z, sizes, edges).items()]
            last = plane
    return sorted(out)


@pytest.mark.parametrize("together", [1, 3])
def test_a_stream_gives_the_names_of_the_plain_fold(spark, tmp_path, together):
    """Several classes and planes, one file or three in a batch; also after a stop between two planes."""
    from runlattice.streaming import planes as stream

    rows = _planes(31, 3, 5)
    path = f"file://{tmp_path}/stream"
    for first, last in ((0, 3), (3, 5)):
        for z in range(first, last):
            spark.createDataFrame([r for r in rows if r[1] == z], stream.PLANE).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run = stream.track_forward(stream.read_planes(spark, f"{path}/in", together), path, width=64).trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted(tuple(r) for r in stream.tracked(spark, path).collect())
    assert got == _folded(rows) and len({r[3] for r in got}) > 30


def test_no_task_of_a_stream_holds_a_plane(spark, tmp_path, monkeypatch):
    """Objects that meet one other only are named without Python, the others in buckets; a gap between planes fails."""
    from runlattice.streaming import planes as stream

    rows = _planes(37, 2, 3)
    path = f"file://{tmp_path}/stream"
    for z in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] == z], stream.PLANE).coalesce(1).write.mode("append").parquet(f"{path}/in")
    monkeypatch.setattr(stream, "TASK_EDGES", 4)
    seen, old = [], stream._carried_on
    monkeypatch.setattr(stream, "_carried_on", lambda *a: seen.append(1) or old(*a))
    stream.track_forward(stream.read_planes(spark, f"{path}/in"), path, width=64).trigger(availableNow=True).start().awaitTermination()
    assert seen == [1] and sorted(tuple(r) for r in stream.tracked(spark, path).collect()) == _folded([r for r in rows if r[1] < 2])
    spark.createDataFrame([(0, 5, 1, 0, 9)], stream.PLANE).coalesce(1).write.mode("append").parquet(f"{path}/in")
    with pytest.raises(Exception, match="plane 5 after plane 1"):
        stream.track_forward(stream.read_planes(spark, f"{path}/in"), path).trigger(availableNow=True).start().awaitTermination()
