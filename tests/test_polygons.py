"""Polygon overlaps against areas on a fine raster, and cases by hand."""

import numpy as np
from pyspark.sql import functions as F

from framestack.operators import joins, polygons

SHAPE = "g string, id int, shape array<struct<x:double,y:double>>"


def hull(rng):
    """Corners of a convex polygon: points of an ellipse, either way round."""
    n = rng.integers(3, 8)
    t = np.sort(rng.uniform(0, 2 * np.pi, n))[:: rng.choice([-1, 1])]
    (cx, cy), (a, b) = rng.uniform(0, 20, 2), rng.uniform(1, 5, 2)
    return [(float(cx + a * np.cos(u)), float(cy + b * np.sin(u))) for u in t]


def inside(points, x, y):
    sides = [(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) for p, q in zip(points, points[1:] + points[:1])]
    return np.all(np.array(sides) >= 0, 0) | np.all(np.array(sides) <= 0, 0)


def test_areas_by_raster(spark):
    rng = np.random.default_rng(12)
    shapes = {i: hull(rng) for i in range(40)}
    step = 0.05
    y, x = np.mgrid[-6:26:step, -6:26:step]
    masks = {i: inside(p, x, y) for i, p in shapes.items()}
    got = {(r.a, r.b): r.area for r in polygons.overlapping(spark.createDataFrame([("g", i, p) for i, p in shapes.items()], SHAPE), ["g"], "id", "shape", 4.0).collect()}
    for i in shapes:
        for j in range(i + 1, 40):
            want = (masks[i] & masks[j]).sum() * step * step
            assert abs(got.get((i, j), 0.0) - want) < 0.02 * (want + 4), (i, j)


def test_by_hand(spark):
    """Touching, nested, equal, turned the other way, without area, unknown, in another group, far across many cells."""
    box = lambda x, y, w=1.0: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    rows = [("g", 1, box(0.0, 0.0)), ("g", 2, box(1.0, 0.0)), ("g", 3, box(0.5, 0.5)[::-1]), ("g", 4, box(0.25, 0.25, 0.5)), ("g", 5, box(0.0, 0.0)), ("h", 6, box(0.0, 0.0)), ("g", 7, [(0.0, 0.0), (5.0, 5.0)]), ("g", 8, None), ("g", 9, [(0.0, None), (1.0, 1.0), (0.0, 1.0)]), ("g", 10, box(-50.0, 10.0, 100.0)), ("g", 11, box(30.0, 30.0, 2.0)), ("g", 12, [])]
    df = spark.createDataFrame(rows, SHAPE)
    got = {(r.a, r.b): round(r.area, 9) for r in polygons.overlapping(df, ["g"], "id", "shape", 3.0).collect()}
    assert got == {(1, 3): 0.25, (1, 4): 0.25, (1, 5): 1.0, (2, 3): 0.25, (3, 4): 0.0625, (3, 5): 0.25, (4, 5): 0.25, (10, 11): 4.0}
    groups = {r.node: r.component for r in joins.components(polygons.overlapping(df, ["g"], "id", "shape", 3.0), "a", "b").collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10}
    assert polygons.overlapping(df.where(F.lit(False)), ["g"], "id", "shape", 3.0).count() == 0


def test_throughput_statuses(spark):
    """A scale with outliers and exposures, and every reason for none."""
    from framestack.operators.photometry import throughput

    rng = np.random.default_rng(4)
    frames = [("R", "ref", "ref", 60.0), ("R", "half", "ref", 30.0), ("R", "few", "ref", 60.0), ("R", "dark", "ref", None), ("R", "none", "ref", 60.0), ("R", "wild", "ref", 60.0), ("B", "alone", None, 60.0), ("R", "half", "ref", 30.0)]
    pairs = []
    for name, n in (("half", 40), ("few", 15), ("dark", 40)):
        ratio = 2.5 * (1 + rng.normal(0, 0.01, n))
        ratio[:2] = 3.4, 9.0
        pairs += [("R", name, 100.0, float(100 * v)) for v in ratio]
    pairs += [("R", "half", -1.0, 5.0), ("R", "half", None, 5.0), ("R", "half", 3.0, float("nan"))]
    pairs += [("R", "wild", 1.0, float(10.0 ** (i / 4 - 4))) for i in range(30)]
    out = throughput(spark.createDataFrame(frames, "f string, n string, reference string, exposure double"), spark.createDataFrame(pairs, "f string, n string, flux double, reference_flux double"), ["f"], "n")
    got = {r.n: r for r in out.collect()}
    assert len(got) == 7
    assert (got["ref"].scale, got["ref"].status) == (1.0, "REFERENCE_IDENTITY")
    assert abs(got["half"].scale - 1.25) < 0.01 and got["half"].stars == 38 and got["half"].status == "STELLAR_SCALE_ACCEPTED"
    assert got["few"].reason == got["none"].reason == "too few positive stellar flux ratios"
    assert got["dark"].reason.startswith("positive source/reference exposure") and got["wild"].reason == "too few bounded stellar flux ratios"
    assert got["alone"].reason == "no reference" and {got[n].scale for n in ("few", "none", "dark", "wild", "alone")} == {None}
