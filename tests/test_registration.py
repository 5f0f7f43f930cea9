import numpy as np
import pytest
from framestack.operators import registration


def _sky(rng, n):
    return rng.uniform(0, 900, n), rng.uniform(0, 700, n), rng.exponential(100, n) + 1


def _rows(frame, x, y, flux):
    return [(frame, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, flux))]


@pytest.fixture(scope="module")
def result(spark):
    """Frames seen shifted, flipped and scaled with noise, spurious and lost stars; unlike skies; too few stars."""
    rng = np.random.default_rng(7)
    true = {"shift": (1.0, 0.0, 12.5, -7.25), "flip": (-1.0, 0.0, 900.0, 700.0), "turn": (0.9 * np.cos(0.3), 0.9 * np.sin(0.3), 40.0, -20.0)}
    source, reference = [], []
    for frame, (a, b, tx, ty) in true.items():
        x, y, flux = _sky(rng, 150)
        u, v = a * x - b * y + tx + rng.normal(0, 0.15, 150), b * x + a * y + ty + rng.normal(0, 0.15, 150)
        lost = rng.random(150) < 0.2
        ex, ey, ef = _sky(rng, 25)
        source += _rows(frame, np.r_[x, ex], np.r_[y, ey], np.r_[flux, ef])
        reference += _rows(frame, u[~lost], v[~lost], (flux * rng.uniform(0.8, 1.2, 150))[~lost])
    source += _rows("other", *_sky(rng, 60))
    reference += _rows("other", *_sky(rng, 60))
    source += _rows("few", [1, 2, 2, None or np.nan], [1, 2, 2, 5], [1, 2, 3, 4])
    reference += _rows("few", *_sky(rng, 30))
    source += _rows("alone", *_sky(rng, 5))
    names = "frame string, sid int, px double, py double, flux double"
    got = registration.register(spark.createDataFrame(source, names), spark.createDataFrame(reference, names), ["frame"], "sid", "px", "py", "flux")
    return true, {r["frame"]: r for r in got.collect()}


def test_known_similarities_are_found(result):
    true, got = result
    for frame, model in true.items():
        r = got[frame]
        assert r["accepted"] and r["reasons"] == [] and r["inliers"] >= 100
        assert np.allclose([r["a"], r["b"]], model[:2], atol=2e-3) and np.allclose([r["tx"], r["ty"]], model[2:], atol=0.5)
        assert 0.05 < r["rms"] < 0.6 and r["source_count"] == 175


def test_reasons_of_pairs_that_do_not_register(result):
    _, got = result
    assert not got["other"]["accepted"] and got["other"]["reasons"]
    for frame in ("few", "alone"):
        assert got[frame]["reasons"] == ["INSUFFICIENT_STARS_FOR_ESTIMATE"] and got[frame]["a"] is None
    assert got["few"]["source_count"] == 2 and got["alone"]["reference_count"] == 0


def test_triangles_fit_compiles(spark, data, capfd):
    """The stage behind the triangle join is compiled, not given up for its size."""
    from framestack.catalogue import QUERIES

    spark.sparkContext.setLogLevel("ERROR")
    capfd.readouterr()
    QUERIES["register_similarity"](spark, data).count()
    assert "grows beyond 64 KB" not in capfd.readouterr().err
