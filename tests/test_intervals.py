import random

import pytest

from runlattice.functions import scalars as S
from runlattice.operators import intervals as I
from runlattice.operators import joins as J


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("ranges", "expected"),
    [([(0, 7), (5, 10)], [(0, 10)]), ([(0, 3), (5, 10)], [(0, 3), (5, 10)]), ([(0, 10), (10, 20)], [(0, 20)]), ([(4, 9)], [(4, 9)]), ([], [])],
)
def test_union_of_ranges(spark, ranges, expected):
    assert rows(I.union(frame(spark, ranges, "s long, e long"), [])) == expected


def test_boxes_that_overlap_have_their_iou(spark):
    schema = "id long, y1 long, x1 long, y2 long, x2 long"
    a = frame(spark, [(1, 0, 0, 20, 20)], schema)
    b = frame(spark, [(2, 5, 5, 25, 25), (3, 30, 30, 40, 40)], schema)
    out = J.box_overlaps(a, b, [("y1", "y2"), ("x1", "x2")], 8).collect()
    assert [(r.id_b, r.inter) for r in out] == [(2, 225)]
    assert out[0].iou == pytest.approx(225 / 575)


def random_sets(seed, n=6, size=60):
    r = random.Random(seed)
    out = []
    for k in range(n):
        at = 0
        while at < size:
            s = at + r.randint(0, 6)
            e = s + r.randint(1, 8)
            out.append((k % 2, k, s, e))
            at = e + r.randint(0, 3)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_interval_algebra_against_sets(spark, seed):
    data = random_sets(seed)
    df = frame(spark, data, "g long, k long, s long, e long").cache()
    cover = {g: {} for g in (0, 1)}
    for g, _, s, e in data:
        for p in range(s, e):
            cover[g][p] = cover[g].get(p, 0) + 1
    top = 100
    for least in (1, 2, 3):
        got = {}
        for g, s, e in rows(I.vote(df, ["g"], least)):
            assert s < e
            got.setdefault(g, []).append((s, e))
        for g, spans in got.items():
            assert {p for s, e in spans for p in range(s, e)} == {p for p, n in cover[g].items() if n >= least}
            assert all(a[1] < b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    outside = {}
    for g, s, e in rows(I.invert(df, ["g"], top)):
        outside.setdefault(g, set()).update(range(s, e))
    assert outside == {g: set(range(top)) - set(cover[g]) for g in cover}
    decoded = I.decode(I.union(df, ["g"]), "p")
    assert rows(I.encode(decoded, ["g"], "p")) == rows(I.union(df, ["g"]))
    cut = rows(I.chunk(df.select("k", "s", "e"), 10))
    assert all(s // 10 == (e - 1) // 10 == c for _, c, s, e in cut)
    assert sum(e - s for _, _, s, e in cut) == sum(e - s for _, _, s, e in data)


def test_overlaps_against_all_pairs(spark):
    r = random.Random(5)
    make = lambda: [(i, r.randint(0, 1), s := r.randint(0, 300), s + r.randint(1, 90)) for i in range(40)]
    a, b = make(), make()
    schema = "id long, g long, s long, e long"
    got = rows(J.overlaps(frame(spark, a, schema), frame(spark, b, schema), ["g"], 32).select("id_a", "id_b", "inter"))
    expected = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == expected


def test_run_strings_round_trip(spark):
    data = [(1, 0, 4), (1, 9, 12), (2, 3, 5)]
    df = frame(spark, data, "label long, s long, e long")
    text = S.runs_to_string(df, ["label"])
    assert dict(rows(text)) == {1: "0 4 9 3", 2: "3 2"}
    assert rows(S.string_to_runs(text, ["label"])) == data
    assert rows(S.string_to_runs(frame(spark, [(1, "")], "label long, rle string"), ["label"])) == []
