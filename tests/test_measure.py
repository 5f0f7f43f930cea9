import numpy as np
import pytest
from framestack.operators import measure


def _field(rng, stars, h=200, w=240, noise=2.0, sigma=1.6):
    y, x = np.mgrid[:h, :w]
    image = 100 + 0.05 * x + 0.03 * y + rng.normal(0, noise, (h, w))
    for sx, sy, peak in stars:
        image += peak * np.exp(-((x - sx) ** 2 + (y - sy) ** 2) / (2 * sigma**2))
    return image


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(11)
    gx, gy = np.meshgrid(np.arange(20, 230, 30), np.arange(20, 190, 30))
    stars = [(a + rng.uniform(-4, 4), b + rng.uniform(-4, 4), p) for a, b, p in zip(gx.ravel(), gy.ravel(), rng.uniform(60, 900, gx.size))]
    images = {"stars": _field(rng, stars), "pair": _field(rng, [(100, 100, 400), (107, 100, 300)]), "blank": _field(rng, [])}
    hot = _field(rng, [])
    hot[50, 60] += 3000
    images |= {"hot": hot, "holes": np.where(rng.random((200, 240)) < 0.05, np.nan, images["stars"]), "nothing": np.full((40, 40), np.nan), "small": np.zeros((8, 90)), "flat": np.full((64, 64), 7.0)}
    rows = [(k, *v.shape, bytearray(v.astype("<f4").tobytes())) for k, v in images.items()] + [("none", None, None, None)]
    done = measure.measured(spark.createDataFrame(rows, "frame string, height int, width int, data binary")).cache()
    return stars, done


def test_planted_stars_are_measured(frames):
    stars, done = frames
    got = measure.star_rows(done).toPandas()
    for frame in ("stars", "holes"):
        mine = got[got.frame == frame]
        assert len(mine) == len(stars) and (np.diff(mine.sort_values("star").flux) <= 0).all()
        for sx, sy, peak in stars:
            near = mine[np.hypot(mine.x - sx, mine.y - sy) < 0.6]
            assert len(near) == 1 and (frame == "holes" or abs(near.peak.iloc[0] / peak - 1) < 0.3)
        assert 3 < mine.fwhm.median() < 5 and mine.ellipticity.median() < 0.2


def test_touching_stars_are_parted_and_hot_pixels_are_raw_only(frames):
    _, done = frames
    got = {r["frame"]: r["count"] for r in measure.star_rows(done).groupBy("frame").count().collect()}
    raw = {r["frame"]: r["count"] for r in measure.star_rows(done, support=0).groupBy("frame").count().collect()}
    assert got.get("pair") == 2 and "blank" not in got and "flat" not in raw
    assert "hot" not in got and raw["hot"] == 1


def test_frames_keep_rows_and_errors(frames):
    stars, done = frames
    rows = {r["frame"]: r for r in measure.frame_rows(done, measure.star_rows(done)).collect()}
    assert {k: r["error"] for k, r in rows.items() if r["error"]} == {"nothing": "NO_FINITE_PIXELS", "small": "PREVIEW_TOO_SMALL", "none": "NO_IMAGE"}
    assert rows["stars"]["detected"] == len(stars) and rows["blank"]["detected"] == 0 and rows["nothing"]["detected"] is None
    assert 0.94 < rows["holes"]["finite_fraction"] < 0.96 and rows["flat"]["mad"] == 0 and rows["hot"]["raw_detected"] == 1
    grid = np.array(done.where("frame = 'stars'").first()["background_grid"])
    y, x = np.mgrid[:16, :16]
    assert grid.shape == (16, 16) and np.abs(grid - (100 + 0.05 * (x + 0.5) * 15 + 0.03 * (y + 0.5) * 12.5)).max() < 3
