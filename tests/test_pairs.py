"""Pairs of boxes and polygons, and what they connect: no broadcast, few edges."""

import random

from framestack.catalogue import QUERIES
from framestack.operators import joins


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_polygons_are_not_broadcast(spark, data):
    assert "Broadcast" not in plan(QUERIES["polygon_overlap"](spark, data))


def test_pairs_of_boxes_meet_on_both_axes_and_are_not_broadcast(spark, data):
    text = plan(QUERIES["overlap_boxes"](spark, data))
    assert "Broadcast" not in text and "cell_1" in text


def test_boxes_on_a_grid_of_both_axes_against_all_pairs(spark):
    pick = random.Random(5)
    boxes = [(i, *[pick.uniform(-20, 20) for _ in range(2)], pick.uniform(0.1, 9), pick.uniform(0.1, 9)) for i in range(120)]
    df = spark.createDataFrame([(i, x, y, x + w, y + h) for i, x, y, w, h in boxes], "id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.a, r.b) for r in joins.overlapping_boxes(df, "id", ["x0", "y0"], ["x1", "y1"], 3.0, [], [3.0, 2.0]).collect()}
    assert got == {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]}


def test_thinned_edges_keep_every_connection(spark):
    dense = [(a, b) for g in range(4) for a in range(100 * g, 100 * g + 60) for b in range(a + 1, 100 * g + 60)] + [(59, 100), (None, 900)]
    edges = spark.createDataFrame(dense, "u long, v long").coalesce(1)
    assert joins._thinned(edges).count() < 400
    got = {r.node: r.component for r in joins.components(edges, "u", "v").where("node is not null").collect()}
    assert got == {g * 100 + k: 0 if g < 2 else g * 100 for g in range(4) for k in range(60)} | {900: 900}
