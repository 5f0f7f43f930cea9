"""Medians of pair slopes that are counted, against all pairs."""

import random

import numpy as np
import pytest

from framestack.operators import stats


@pytest.mark.parametrize("few, size", [(40, 16), (2_000_000, 4096)])
def test_counted_slopes_against_all_pairs(spark, monkeypatch, few, size):
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "LIST", size)
    pick = random.Random(3)
    rows = [(g, pick.randrange(3), 1 + pick.randrange(11) / 5.0, pick.randrange(60) / 100) for g in "ab" for _ in range(200)]
    rows += [("c", 0, 1.0, 0.5), ("c", 1, 2.0, 0.7), ("d", 0, 1.0, 0.0), ("d", 0, 1.2, 0.4)]
    got = stats.pair_slopes(spark.createDataFrame(rows, "g string, w long, x double, y double"), ["g"], "w", "x", "y", 0.05, 2.0)
    want = {}
    for g in "abcd":
        own = [r[1:] for r in rows if r[0] == g]
        s = [(q[2] - p[2]) / (q[1] - p[1]) for i, p in enumerate(own) for q in own[i + 1 :] if p[0] == q[0] and abs(q[1] - p[1]) >= 0.05]
        s = [v for v in s if abs(v) <= 2.0]
        if s:
            want[g] = (len(s), float(np.quantile(s, 0.5)))
    assert {r.g: (r.pairs, pytest.approx(r.slope, abs=1e-12)) for r in got.collect()} == want
