"""Areas that polygons share, row by row: by rims and by cuts; pairs across blocks; links that span what pairs connect."""

import numpy as np

from framestack.catalogue import QUERIES
from framestack.operators import joins, polygons


def quads(rng, n):
    c, (w, h, t) = rng.uniform(0, 5, (2, n)), rng.uniform((1, 1, 0), (4, 3, 3), (n, 3)).T
    k = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)])
    return tuple(c[i][:, None] + k[:, 0] * (w * u)[:, None] + k[:, 1] * (h * v)[:, None] for i, u, v in ((0, np.cos(t), -np.sin(t)), (1, np.sin(t), np.cos(t))))


def test_rims_give_the_areas_of_cuts():
    rng = np.random.default_rng(3)
    a, b = quads(rng, 2000), quads(rng, 2000)
    assert np.abs(polygons.shared_areas(*a, *b) - polygons._cut_areas(*a, *b)).max() < 1e-9


def test_sides_on_one_line_count_once():
    """Boxes of 4 x 3 moved by halves, turned by any angle and rounded: whole sides lie on one another, or nearly so."""
    rng = np.random.default_rng(4)
    n = 3000
    t, step = rng.uniform(0, 6, n)[:, None], rng.integers(-9, 10, (2, n, 1)) / 2
    x, y = np.array([[0, 4, 4, 0.0]]), np.array([[0, 0, 3, 3.0]])
    turned = lambda u, v: (u * np.cos(t) - v * np.sin(t) + 1e3, u * np.sin(t) + v * np.cos(t) - 77)
    want = (np.maximum(4 - np.abs(step[0]), 0) * np.maximum(3 - np.abs(step[1]), 0))[:, 0]
    assert np.abs(polygons.shared_areas(*turned(x, y), *turned(x + step[0], y + step[1])) - want).max() < 1e-7


def test_crowded_cells_are_met_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = quads(rng, 150)
    df = spark.createDataFrame([("g", i, [(float(u), float(v)) for u, v in zip(x[i], y[i])]) for i in range(150)], "g string, id long, shape array<struct<x:double,y:double>>")
    pairs = lambda **more: {(r.a, r.b): round(r.area, 9) for r in polygons.overlapping(df, ["g"], "id", "shape", 4.0, **more).collect()}
    i, j = np.triu_indices(150, 1)
    areas = polygons._cut_areas(x[i], y[i], x[j], y[j])
    want = {(int(a), int(b)): round(float(v), 9) for a, b, v in zip(i, j, areas) if v > 0.01}
    assert pairs(least=0.01) == want
    monkeypatch.setattr(polygons, "BLOCK", 7)
    assert pairs(least=0.01) == want


def test_spanning_links_connect_what_pairs_connect_in_fewer_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = quads(rng, 400)
    x += np.repeat([0, 100, 200, 300], 100)[:, None]
    df = spark.createDataFrame([("g", i, [(float(u), float(v)) for u, v in zip(x[i], y[i])]) for i in range(400)], "g string, id long, shape array<struct<x:double,y:double>>")
    found = [polygons.overlapping(df, ["g"], "id", "shape", 4.0, spanning=s) for s in (False, True)]
    assert found[1].count() * 5 < found[0].count()
    a, b = ({r.node: r.component for r in joins.components(f, "a", "b").collect()} for f in found)
    assert a == b and len(set(a.values())) == 4


def test_polygons_are_measured_in_python_not_by_expressions(spark, data):
    plan = QUERIES["polygon_overlap"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan


def test_edges_of_many_batches_are_thinned_together(spark):
    edges = spark.range(60000).selectExpr("id % 100 AS u", "(id * 7 + 1) % 100 AS v").where("u <> v").coalesce(1)
    assert joins._thinned(edges).count() <= 100
