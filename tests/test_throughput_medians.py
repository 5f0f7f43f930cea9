"""Medians of many stars' ratios are counted in bins, with the result of medians taken at once."""

import numpy as np

from framestack.operators import photometry


def test_many_ratios_give_the_scales_of_few(spark, monkeypatch):
    rng = np.random.default_rng(9)
    frames = [("ref", "ref", 60.0), ("a", "ref", 30.0), ("b", "ref", 20.0), ("few", "ref", 60.0)]
    pairs = [(n, 100.0, float(100 * s * (1 + rng.normal(0, 0.02) * rng.choice([1, 9], p=[0.9, 0.1])))) for n, s, k in (("ref", 1, 50), ("a", 2, 900), ("b", 3.1, 77), ("few", 1, 9)) for _ in range(k)]
    frames, pairs = spark.createDataFrame(frames, "n string, reference string, exposure double"), spark.createDataFrame(pairs, "n string, flux double, reference_flux double").coalesce(1)
    got = []
    for few in (photometry.FEW, 0):
        monkeypatch.setattr(photometry, "FEW", few)
        got.append(sorted((r.n, r.status, r.stars, r.scale and round(r.scale, 9), r.sigma and round(r.sigma, 9)) for r in photometry.throughput(frames, pairs, [], "n").collect()))
    assert got[0] == got[1] and [g[1][:15] for g in got[0]] == ["STELLAR_SCALE_A", "STELLAR_SCALE_A", "STELLAR_SCALE_U", "REFERENCE_IDENT"]
