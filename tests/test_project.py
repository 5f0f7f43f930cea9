import numpy as np
import pytest
from pyspark.sql import functions as F

from framestack.operators import measure
from framestack.plans import project
from framestack.sources import fits


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three nights' worth of bias, dark, flat and light frames with a hot pixel, a trail and a duplicate."""
    root, rng = tmp_path_factory.mktemp("frames"), np.random.default_rng(73)
    h, w = 40, 32
    y, x = np.mgrid[:h, :w]
    response = 1 - 0.25 * ((x - 16) ** 2 + (y - 20) ** 2) / 600
    sky = 100 + 400 * np.exp(-((x - 10.0) ** 2 + (y - 25.0) ** 2) / 6)

    def save(name, image, **cards):
        head = {"INSTRUME": "cam", "XBINNING": 1, "GAIN": 100.0, "DATE-OBS": "2026-08-17T22:00:00"} | cards
        (root / name).write_bytes(fits.encode(image + rng.normal(0, 0.5, (h, w)), head))

    for i in range(3):
        save(f"b{i}.fits", np.full((h, w), 1000.0), IMAGETYP="Bias Frame", EXPTIME=0.001)
        save(f"d{i}.fits", np.full((h, w), 1014.0), IMAGETYP="DARK", EXPTIME=60.0)
        save(f"e{i}.fits", np.full((h, w), 1100.0), IMAGETYP="DARK", EXPTIME=600.0)
        save(f"flat_{i}.fits", 1000 + 24000 * response, FILTER="red", EXPTIME=2.0)
    for i in range(7):
        frame = 1014 + sky * response
        if i == 2:
            frame[30, :] += 5000
        save(f"l{i}.fits", frame, IMAGETYP="Light", EXPTIME=60.0, FILTER="R", OBJECT="NGC 1")
    (root / "copy.fits").write_bytes((root / "l0.fits").read_bytes())
    (root / "broken.fits").write_bytes(b"SIMPLE")
    return str(root), sky


def test_inventory(spark, folder):
    frames = project.assets(spark, folder[0])
    rows = {r["path"].rsplit("/")[-1]: r for r in frames.collect()}
    assert len(rows) == 20 and ("copy.fits" in rows) != ("l0.fits" in rows)
    assert rows["flat_1.fits"]["role"] == "FLAT" and rows["flat_1.fits"]["filter"] == "R" and rows["b0.fits"]["role"] == "BIAS"
    assert str(rows["l1.fits"]["night"]) == "2026-08-17"
    assert {(r["path"].rsplit("/")[-1], r["code"]) for r in project.issues(frames).collect()} == {("broken.fits", "UNREADABLE")}


def test_lights_take_the_nearest_dark(spark, folder):
    frames = project.assets(spark, folder[0]).where("error is null")
    groups = project.calibration_groups(frames)
    assert {(r["role"], r["count"]) for r in groups.select("role", "group").distinct().groupBy("role").count().collect()} == {("BIAS", 1), ("DARK", 2), ("FLAT", 1)}
    by = {r["group"]: r["e"] for r in groups.where("role = 'DARK'").groupBy("group").agg({"exposure": "max"}).toDF("group", "e").collect()}
    got = project.matches(frames, groups).collect()
    assert {by[r["dark"]] for r in got if r["role"] == "LIGHT"} == {60.0} and all(r["dark"] is None for r in got if r["role"] == "FLAT")


def test_masters_recover_the_sky(spark, folder):
    path, sky = folder
    rows = project.masters(spark, path, rows=16).collect()
    assert [(r["target"], r["filter"]) for r in rows] == [("NGC 1", "R")]
    got = fits.decode_rows(rows[0]["content"])
    scale = np.median(got / sky)
    assert np.abs(got / scale - sky).max() < 4


def test_measured_frames_register(spark, tmp_path):
    """Frames of one sky, shifted by known amounts, from files to similarities."""
    rng = np.random.default_rng(21)
    gx, gy = np.meshgrid(np.arange(24, 280, 32), np.arange(24, 220, 32))
    sx, sy = gx.ravel() + rng.uniform(-7, 7, gx.size), gy.ravel() + rng.uniform(-7, 7, gx.size)
    peak = rng.uniform(200, 2000, gx.size)
    y, x = np.mgrid[:240, :300]
    shifts = {"a.fits": (0.0, 0.0), "b.fits": (6.5, -3.25), "c.fits": (-9.0, 4.5)}
    for name, (dx, dy) in shifts.items():
        sky = sum(p * np.exp(-((x - a - dx) ** 2 + (y - b - dy) ** 2) / 5) for a, b, p in zip(sx, sy, peak))
        (tmp_path / name).write_bytes(fits.encode(100 + sky + rng.normal(0, 2, sky.shape), {"IMAGETYP": "Light"}))
    (tmp_path / "d.fits").write_bytes(fits.encode(100 + rng.normal(0, 2, (240, 300))))
    done = project.measures(spark, str(tmp_path))
    stars = measure.star_rows(done, "path")
    members = done.select(F.lit("g").alias("g"), "path")
    got = {r["path"].rsplit("/")[-1]: r for r in project.registrations(stars, members, ["g"]).collect()}
    first = next(iter({r["reference"] for r in got.values()})).rsplit("/")[-1]
    assert len(got) == 4 and not got["d.fits"]["accepted"] and got["d.fits"]["reasons"] == ["INSUFFICIENT_STARS_FOR_ESTIMATE"]
    for name, (dx, dy) in shifts.items():
        r = got[name]
        assert r["accepted"] and abs(r["a"] - 1) < 1e-3 and abs(r["b"]) < 1e-3
        assert abs(r["tx"] - (shifts[first][0] - dx)) < 0.3 and abs(r["ty"] - (shifts[first][1] - dy)) < 0.3


@pytest.mark.parametrize("most", [150])
def test_unregistered_frames_stack(spark, tmp_path, most):
    """Shifted and turned frames of one sky, with a frame of nothing, from files to a stack on the grid of one of them."""
    rng = np.random.default_rng(31)
    gx, gy = np.meshgrid(np.arange(28, 280, 36), np.arange(28, 220, 36))
    sx, sy = gx.ravel() + rng.uniform(-8, 8, gx.size), gy.ravel() + rng.uniform(-8, 8, gx.size)
    peak = rng.uniform(300, 3000, gx.size)
    y, x = np.mgrid[:240, :300]

    def sky(angle, dx, dy):
        px, py = np.cos(angle) * sx - np.sin(angle) * sy + dx, np.sin(angle) * sx + np.cos(angle) * sy + dy
        return 100 + sum(p * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 18) for a, b, p in zip(px, py, peak))

    moves = {"a": (0, 0, 0), "b": (0.02, 6.5, -3.25), "c": (-0.03, -4.0, 7.5), "d": (0, 3.3, 2.2), "e": (0.01, 0.0, 5.0)}
    cards = {"IMAGETYP": "Light", "FILTER": "R", "EXPTIME": 60.0, "OBJECT": "M 1"}
    for name, move in moves.items():
        (tmp_path / f"{name}.fits").write_bytes(fits.encode(sky(*move) + rng.normal(0, 2, x.shape), cards))
    (tmp_path / "z.fits").write_bytes(fits.encode(100 + rng.normal(0, 2, x.shape), cards))
    matrices = project.frame_matrices(spark, str(tmp_path), project.assets(spark, str(tmp_path)).select("target", "path"), ["target"], most)
    names = {r.path.rsplit("/")[-1][0]: r for r in matrices.collect()}
    first = next(iter({r.reference for r in names.values()})).rsplit("/")[-1][0]
    assert [n for n, r in names.items() if not r.accepted] == ["z"] and names["z"].m is None
    rows = project.registered_stacks(spark, str(tmp_path), 64, most).collect()
    assert {(r.target, r.filter) for r in rows} == {("M 1", "R")} and len(rows) == 4 * 5
    got, count = np.full((256, 320), np.nan), np.zeros((256, 320))
    for r in rows:
        got[r.y0 : r.y0 + 64, r.x0 : r.x0 + 64] = np.frombuffer(r.data, "<f4").reshape(64, 64)
        count[r.y0 : r.y0 + 64, r.x0 : r.x0 + 64] = (np.frombuffer(r.accepted, "<u4") + np.frombuffer(r.rejected, "<u4")).reshape(64, 64)
    got, count = got[:240, :300], count[:240, :300]
    want = sky(*moves[first])
    inner = count == 5
    assert inner[30:200, 30:250].all() and (count <= 5).all()
    assert np.median(np.abs(got - want)[inner]) < 1.5 and np.abs(got - want)[inner].max() < 0.05 * 3000
