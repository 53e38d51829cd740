import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["object_sizes", "join_ranges", "vote_k2", "invert_ranges", "rle_iou", "box_iou", "relabel", "count_labels", "tile_crop", "erode", "panoptic_merge"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    place = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in place)) for r in rel.fetchall())


def test_joins_have_no_nested_loops(spark):
    from runlattice.operators import joins

    runs = spark.createDataFrame([(1, 2, 0, 9)], "y long, label long, s long, e long")
    boxes = spark.createDataFrame([(1, 0, 0, 9, 9)], "id long, y1 long, x1 long, y2 long, x2 long")
    for df in (joins.scores(runs, runs, ["y"], ["label"], 64), joins.box_overlaps(boxes, boxes, [("y1", "y2"), ("x1", "x2")], 8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
