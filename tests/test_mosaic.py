"""Networks against numpy's least squares, planted gains and surfaces, and sky rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestack.operators import mosaic

SIDE = 100.0


def grid(nx, ny, rng, errors=(0.005, 0.02), slopes=None, outliers=0.03):
    """Observations of a grid of panels that overlap their right, lower and diagonal neighbours."""
    truth = rng.normal(0, 0.2, nx * ny)
    slopes = slopes if slopes is not None else np.zeros((nx * ny, 2))
    centre, length = ((nx * SIDE - 1) / 2, (ny * SIDE - 1) / 2), max(nx, ny) * SIDE / 2
    rows = []
    for i in range(nx * ny):
        x, y = i % nx, i // nx
        for j in [i + 1] * (x < nx - 1) + [i + nx] * (y < ny - 1) + [i + nx + 1] * (x < nx - 1 and y < ny - 1):
            for _ in range(4):
                px, py = (float(v) for v in ((x + rng.random()) * SIDE, (y + rng.random()) * SIDE))
                at = np.array([(px - centre[0]) / length, (py - centre[1]) / length])
                e = float(rng.uniform(*errors))
                step = truth[i] - truth[j] + (slopes[i] - slopes[j]) @ at
                rows.append((f"p{i}", f"p{j}", px, py, float(-step + rng.normal(0, e) + (0.5 if rng.random() < outliers else 0)), e))
    panels = [(f"p{i}", (i % nx) * SIDE, (i // nx) * SIDE, (i % nx + 1) * SIDE, (i // nx + 1) * SIDE, 1.0) for i in range(nx * ny)]
    return truth, rows, panels, centre, length


def by_numpy(rows, n, terms, centre, length):
    a = np.zeros((len(rows) + (2 * n if terms == 3 else 0), terms * n))
    target, sigma = np.zeros(len(a)), np.full(len(a), mosaic.GRADIENT_PRIOR)
    for k, (left, right, x, y, ratio, error) in enumerate(rows):
        t = [1, (x - centre[0]) / length, (y - centre[1]) / length][:terms]
        i, j = int(left[1:]), int(right[1:])
        a[k, terms * i : terms * i + terms] = t
        a[k, terms * j : terms * j + terms] = np.negative(t)
        target[k], sigma[k] = -ratio, error
    for i in range(n if terms == 3 else 0):
        a[len(rows) + 2 * i, 3 * i + 1] = a[len(rows) + 2 * i + 1, 3 * i + 2] = 1
    w = np.ones(len(a))
    for _ in range(mosaic.PASSES):
        x = np.linalg.lstsq(a * (w / sigma)[:, None], target * w / sigma, rcond=None)[0]
        z = np.abs((target - a @ x) / sigma)
        z[len(rows) :] = 0
        w = np.where(z <= mosaic.HUBER, 1, np.sqrt(mosaic.HUBER / np.maximum(z, 1e-12)))
    return x.reshape(n, terms)


OBSERVED = "left string, right string, x double, y double, log_ratio double, error double"
PANELS = "panel string, x0 double, y0 double, x1 double, y1 double, exposure double"


@pytest.mark.parametrize("terms", [1, 3])
def test_solution_is_numpys(spark, terms):
    """Several blocks, so that conjugate gradients have to work; outliers, so that weights do."""
    rng = np.random.default_rng(terms)
    nx, ny = (6, 4) if terms == 1 else (4, 2)
    _, rows, panels, centre, length = grid(nx, ny, rng)
    observed = spark.createDataFrame(rows + [(None, "p1", 0.0, 0.0, 1.0, 1.0), ("p1", "p2", 0.0, 0.0, None, 1.0)], OBSERVED)
    places = mosaic.placed(spark.createDataFrame(panels, PANELS), most=8 if terms == 1 else 4)
    assert places.select("block").distinct().count() > 1
    got = {r["panel"]: r["x"] for r in mosaic.solve(mosaic.scale_rows(observed.where("log_ratio is not null"), centre, length, terms == 3), terms, places).collect()}
    want = by_numpy(rows, nx * ny, terms, centre, length)
    mine = np.array([got[f"p{i}"] for i in range(nx * ny)])
    off = mine - want
    off[:, 0] -= off[:, 0].mean()  # a common level is not seen
    assert np.abs(off).max() < 1e-6


def test_gains_choose_their_model(spark):
    rng = np.random.default_rng(5)
    slopes = rng.normal(0, 0.15, (6, 2))
    truth, rows, panels, centre, length = grid(3, 2, rng, (0.001, 0.002), slopes, 0)
    rows = [r for r in rows for _ in range(3)]
    panels[2] = (*panels[2][:5], 1e6)
    got = {r["panel"]: r for r in mosaic.scales(spark.createDataFrame(rows, OBSERVED), spark.createDataFrame(panels, PANELS)).collect()}
    assert {r["model"] for r in got.values()} == {"gainPlane"}
    levels = truth + np.log([p[5] for p in panels])
    zero = int(np.argmin(levels))
    assert got[f"p{zero}"]["scale"] == 1.0
    ours = np.array([[got[f"p{i}"]["a"], got[f"p{i}"]["b"]] for i in range(6)])
    assert np.abs((ours - ours.mean(0)) - (slopes - slopes.mean(0))).max() < 0.05
    one = mosaic.scales(spark.createDataFrame(rows[:0], OBSERVED), spark.createDataFrame(panels[:1], PANELS)).collect()
    assert [(r["scale"], r["a"], r["model"]) for r in one] == [(1.0, 0.0, "scale")]


def test_surfaces_take_gradients_out_and_leave_the_object(spark):
    """Two by two panels with planted tilts; a bright patch is in the sky of all, and must stay."""
    rng = np.random.default_rng(7)
    size, step = 512, 448
    panels = [(f"p{i}", float(i % 2 * step), float(i // 2 * step), float(i % 2 * step + size), float(i // 2 * step + size), 1.0) for i in range(4)]
    tilt = rng.normal(0, 6, (4, 3))
    patch = lambda x, y: 400.0 * np.exp(-((x - 480) ** 2 + (y - 480) ** 2) / (2 * 90.0**2))

    def value(i, x, y):
        u, v = (x - panels[i][1] - (size - 1) / 2) / 480, (y - panels[i][2] - (size - 1) / 2) / 480
        return 1000 + patch(x, y) + tilt[i] @ [1, u, v]

    sky = []
    for i, p in enumerate(panels):
        for c in range(size // 64):
            for r in range(size // 64):
                x, y = p[1] + (c + 0.5) * 64, p[2] + (r + 0.5) * 64
                sky.append((p[0], c, r, x, y, float(value(i, x, y) + rng.normal(0, 0.3)), 4.0))
    overlaps = []
    for i in range(4):
        for j in range(i + 1, 4):
            lo = [max(panels[i][k], panels[j][k]) for k in (1, 2)]
            hi = [min(panels[i][k], panels[j][k]) for k in (3, 4)]
            for x in np.arange(lo[0] + 16, hi[0], 32):
                for y in np.arange(lo[1] + 16, hi[1], 32):
                    overlaps.append((f"p{i}", f"p{j}", float(x), float(y), float(value(i, x, y) + rng.normal(0, 0.1)), float(value(j, x, y) + rng.normal(0, 0.1)), 0.1, 1e-5))
    scaled = spark.createDataFrame([(p[0], "scale", 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0) for p in panels], "panel string, model string, log_scale double, scale double, a double, b double, u0 double, v0 double, length double")
    out, kept = mosaic.surfaces(
        spark.createDataFrame(overlaps, "left string, right string, x double, y double, left_value double, right_value double, noise double, ratio_error double"),
        spark.createDataFrame(sky, "panel string, col long, row long, x double, y double, value double, noise double"),
        scaled,
        spark.createDataFrame(panels, PANELS),
        rounds=3,
    )
    got = {r["panel"]: r for r in out.collect()}
    assert abs(sum(r["coefficients"][0] for r in got.values())) < 1e-6
    places = spark.createDataFrame(sky, "panel string, col long, row long, x double, y double, value double, noise double").join(out, "panel")
    flat = places.withColumn("flat", F.col("value") - mosaic.surface(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), F.col("length"))).collect()
    far = np.array([r["flat"] for r in flat if patch(r["x"], r["y"]) < 0.5])
    assert np.ptp(far) < 0.25 * np.ptp([value(i, p[1] + c, p[2] + r) - patch(p[1] + c, p[2] + r) for i, p in enumerate(panels) for c in (0, size) for r in (0, size)])
    near = np.array([r["flat"] - np.median(far) - patch(r["x"], r["y"]) for r in flat if patch(r["x"], r["y"]) > 300])
    assert np.abs(near).max() < 40  # of 400
    assert 0 < kept.count() < len(sky)
    assert max(patch(r["x"], r["y"]) for r in kept.collect()) < 100
