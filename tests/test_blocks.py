"""Block operators against the same work on whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestack.operators import blocks as B

SIDE = 8


def frame(spark, images):
    rows = [(n, int(y), int(x), float(v)) for n, im in images.items() for (y, x), v in np.ndenumerate(im) if np.isfinite(v)]
    return B.from_pixels(spark.createDataFrame(rows, "f string, y long, x long, v double"), ["f"], "y", "x", "v", SIDE)


def whole(df, shape, name):
    out = np.full(shape, np.nan)
    for r in B.to_pixels(df, ["f"], SIDE).where(F.col("f") == name).collect():
        out[r.y, r.x] = r.value
    return out


def image(seed=1, shape=(83, 61)):
    rng = np.random.default_rng(seed)
    v = rng.normal(100, 20, shape)
    v[11, 17] = np.nan
    return v


def asked(spark, images, matrices, shape):
    rows = [(n, *images[n].shape, *shape, [float(a) for a in np.ravel(m)]) for n, m in matrices.items()]
    return spark.createDataFrame(rows, "f string, height int, width int, out_height int, out_width int, m array<double>")


TURN = lambda a, dx, dy: np.array([[np.cos(a), -np.sin(a), dx], [np.sin(a), np.cos(a), dy], [0, 0, 1]])


@pytest.mark.parametrize("linear", [False, True])
def test_warp_equals_the_whole_image(spark, linear):
    """Ten blocks high: shifts, turns, a homography whose divisor changes sign, one that sees nothing; every edge is the same."""
    matrices = {"shift": [[1, 0, 3.25], [0, 1, -2.5], [0, 0, 1]], "turn": TURN(0.7, 20, -9), "view": [[1, 0.02, 1], [0.01, 0.98, 2], [1e-3, 5e-4, 1]], "horizon": [[1, 0, 0], [0, 1, 0], [-0.03, 0, 1]], "away": [[1, 0, 5000], [0, 1, 0], [0, 0, 1]]}
    images = {n: image(i) for i, n in enumerate(matrices)}
    shape = (90, 66)
    out = B.warp(frame(spark, images), B.matrix_windows(asked(spark, images, matrices, shape), ["f"], SIDE), ["f"], SIDE, linear=linear, domain=130.0).cache()
    assert out.count() == len(matrices) * 12 * 9
    for n, m in matrices.items():
        y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
        m = np.array(m, float)
        d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
        with np.errstate(all="ignore"):
            want = B.sample(images[n], (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d, 0, 0, *images[n].shape, 130.0, linear)
        np.testing.assert_allclose(whole(out, shape, n), want, rtol=1e-12, atol=1e-9, err_msg=n)
        assert np.isfinite(want).any() == (n != "away")


def test_sample_by_loops():
    """Weights, range and missing pixels, pixel by pixel."""
    v = image(7, (20, 22))
    rng = np.random.default_rng(3)
    sx, sy = rng.uniform(-2, 24, (9, 9)), rng.uniform(-2, 22, (9, 9))
    sx[0, :3], sy[0, :3] = (19, 2, 5), (17, 2, 6.5)
    got = B.sample(v, sx, sy, 0, 0, *v.shape, 110.0)
    kernel = lambda t: 1.0 if t == 0 else 0.0 if abs(t) >= 3 or t == int(t) else 3 * np.sin(np.pi * t) * np.sin(np.pi * t / 3) / (np.pi * t) ** 2
    for at in np.ndindex(sx.shape):
        x, y = sx[at], sy[at]
        want = np.nan
        if 2 <= x <= 19 and 2 <= y <= 17:
            i0, j0 = int(np.floor(x)), int(np.floor(y))
            held = [(kernel(x - i) * kernel(y - j), v[min(j, 19), min(i, 21)]) for j in range(j0 - 2, j0 + 4) for i in range(i0 - 2, i0 + 4)]
            held = [(w, p) for w, p in held if w]
            if all(np.isfinite(p) for _, p in held):
                want = sum(w * p for w, p in held) / sum(w for w, _ in held)
                want = min(max(want, min(0.0, *[p for _, p in held])), max(110.0, *[p for _, p in held]))
        np.testing.assert_allclose(got[at], want, rtol=1e-10)


def test_copies_keep_edges(spark):
    images = {"same": image(1), "turned": image(2)}
    h, w = images["same"].shape
    out = B.warp(frame(spark, images), B.matrix_windows(asked(spark, images, {"same": np.eye(3), "turned": TURN(np.pi, w - 1, h - 1)}, (h, w)), ["f"], SIDE), ["f"], SIDE)
    np.testing.assert_array_equal(whole(out, (h, w), "same"), images["same"])
    np.testing.assert_array_equal(whole(out, (h, w), "turned"), images["turned"][::-1, ::-1])


def test_lattice_and_composition(spark):
    """A lattice of an affine map is that map; with a matrix the two are one interpolation."""
    images = {"a": image(4), "b": image(5)}
    shape, spacing = (70, 50), 4
    first, second = TURN(0.2, 5, 3), TURN(-0.1, 2, 4)
    nodes = [(f, ny, nx, *(first @ [nx * spacing, ny * spacing, 1])[:2].tolist()) for f in "ab" for ny in range(-(-shape[0] // spacing) + 1) for nx in range(-(-shape[1] // spacing) + 1)]
    lattice = spark.createDataFrame(nodes, "f string, ny int, nx int, sx double, sy double")
    rows = asked(spark, images, {"a": np.eye(3), "b": second}, shape).withColumn("m", F.when(F.col("f") == "b", F.col("m")))
    out = B.warp(frame(spark, images), B.lattice_windows(rows, lattice, ["f"], spacing, SIDE), ["f"], SIDE, spacing=spacing).cache()
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    for n, m in (("a", first), ("b", second @ first)):
        want = B.sample(images[n], m[0, 0] * x + m[0, 1] * y + m[0, 2], m[1, 0] * x + m[1, 1] * y + m[1, 2], 0, 0, *images[n].shape, None)
        np.testing.assert_allclose(whole(out, shape, n), want, rtol=1e-8)
    half = spark.createDataFrame([("m", [2.0, 0.0, 1.0, 0.0, 4.0, 2.0, 0.0, 0.0, 1.0]), ("s", [0.0] * 9)], "k string, m array<double>")
    back = {r.k: r.i for r in half.select("k", B.inverse(F.col("m")).alias("i")).collect()}
    assert back["s"] is None and np.allclose(np.reshape(back["m"], (3, 3)), np.linalg.inv([[2, 0, 1], [0, 4, 2], [0, 0, 1]]))


def test_bands_become_blocks(spark):
    v = image(6, (19, 21)).astype("<f4")
    bands = spark.createDataFrame([("a", y, min(SIDE, 19 - y), 21, v[y : y + SIDE].tobytes()) for y in range(0, 19, SIDE)], "f string, y0 int, rows int, width int, data binary")
    made = B.from_bands(bands, ["f"], SIDE)
    assert made.count() == 9
    got = np.full(v.shape, np.nan, "<f4")
    for r in B.to_pixels(made, ["f"], SIDE, "<f4").collect():
        got[r.y, r.x] = r.value
    np.testing.assert_array_equal(got, v)


def filled(mask, diagonal):
    """Labels by flooding from each first pixel."""
    out = np.full(mask.shape, -1)
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x] >= 0:
            continue
        todo, name = [(y, x)], y * B.COLUMNS + x
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and out[a, b] < 0:
                out[a, b] = name
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    return out


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_equal_flooding(spark, diagonal):
    rng = np.random.default_rng(5)
    spiral = np.full((40, 40), -1.0)
    spiral[::4], spiral[:, 0], spiral[:, -1] = 1, 1, -1
    spiral[2::8, -1] = 1
    images = {"noise": rng.normal(0, 1, (45, 37)), "snake": spiral, "full": np.ones((17, 17)), "none": np.zeros((9, 9)) - 1}
    held = frame(spark, images)
    joined = B.joined_parts(B.label_parts(held, ["f"], 0.0, SIDE, diagonal=diagonal), ["f"], diagonal).cache()
    labels = B.label_blocks(held, joined, ["f"], 0.0, SIDE, diagonal=diagonal)
    rows = B.regions(joined, ["f"]).collect()
    for n, v in images.items():
        want = filled(v > 0, diagonal)
        got = np.full(v.shape, -1)
        for r in B.to_pixels(labels, ["f"], SIDE, "<i8").where(F.col("f") == n).collect():
            got[r.y, r.x] = r.value
        np.testing.assert_array_equal(got, want)
        mine = {(r.label, r.y, r.x, r.n, r.y0, r.x0, r.y1, r.x1, round(r.total, 9), r.peak) for r in rows if r.f == n}
        theirs = set()
        for name in np.unique(want[want >= 0]):
            y, x = np.nonzero(want == name)
            theirs.add((name, name // B.COLUMNS, name % B.COLUMNS, len(y), y.min(), x.min(), y.max(), x.max(), round(v[y, x].sum(), 9), v[y, x].max()))
        assert mine == theirs
    big = B.label_blocks(held, joined, ["f"], 0.0, SIDE, diagonal=diagonal, least=10)
    kept = {r.value for r in B.to_pixels(big, ["f"], SIDE, "<i8").where("f = 'noise'").collect()}
    assert kept == {r.label for r in rows if r.f == "noise" and r.n >= 10}


def test_apertures_by_loops(spark):
    v = image(9, (40, 44))
    stars = [("a", 1, 12.3, 9.8), ("a", 2, 20.0, 24.0), ("a", 3, 1.0, 20.0), ("a", 4, 17.5, 11.0), ("a", 5, 300.0, 2.0), ("a", 6, None, 2.0), ("a", 2, 20.0, 24.0)]
    df = spark.createDataFrame(stars, "f string, s int, x double, y double")
    got = {r.s: r for r in B.apertures(df, frame(spark, {"a": v}), ["f"], "s", "x", "y", 3.0, 5.0, 7.5, SIDE).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    yy, xx = np.mgrid[: v.shape[0], : v.shape[1]]
    for _, s, x, y in stars[:5]:
        d2 = (yy - y) ** 2 + (xx - x) ** 2
        disk, ring = d2 < 9, (d2 >= 25) & (d2 < 56.25) & np.isfinite(v)
        assert got[s].n == (disk & np.isfinite(v)).sum()
        missing = s in (3, 4, 5)  # beyond the border, over a missing pixel, outside
        assert (got[s].flux is None) == missing
        if not missing:
            assert np.isclose(got[s].flux, v[disk].sum() - disk.sum() * v[ring].mean())


def test_apertures_on_ties(spark):
    """Centres exactly on the circle (3-4-5 steps of a fifth) are counted alike by the sums and by the needed centres, in any block."""
    v = np.ones((50, 50))
    stars = [("a", i, 9.8 + (i % 7) * 4, 9.4 + (i // 7) * 4) for i in range(49)]
    rows = B.apertures(spark.createDataFrame(stars, "f string, s int, x double, y double"), frame(spark, {"a": v}), ["f"], "s", "x", "y", 3.0, 5.0, 7.0, SIDE).collect()
    assert len(rows) == 49 and all(r.flux is not None and abs(r.flux) < 1e-9 for r in rows)
