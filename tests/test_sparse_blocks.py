"""Blocks of images that lines fill in part: no rows of empty pixels, no broadcast of windows or stars."""

import random

import numpy as np
import pytest

from framestack.catalogue import QUERIES
from framestack.operators import blocks


def test_blocks_of_few_pixels_hold_whole_images(spark):
    pick = random.Random(8)
    images = {"a": (10, 37), "b": (4, 4), "c": (0, 9)}
    rows = [(f, pick.randrange(-2, 40), pick.randrange(-2, 40), pick.choice([None, 1.0, 2.5, 4.0])) for f in ("a", "b") for _ in range(300)]
    pixels = spark.createDataFrame(rows, "f string, y int, x int, v double").repartition(5)
    held = blocks.from_sparse(pixels, spark.createDataFrame([(f, *s) for f, s in images.items()], "f string, height int, width int"), ["f"], "y", "x", "v", 8)
    got = {(r.f, r.by, r.bx): np.frombuffer(r.data).reshape(8, 8) for r in held.collect()}
    assert set(got) == {("a", y, x) for y in range(2) for x in range(5)} | {("b", 0, 0)}
    for f in ("a", "b"):
        for y in range(-(-images[f][0] // 8) * 8):
            for x in range(-(-images[f][1] // 8) * 8):
                v = [r[3] for r in rows if r[:3] == (f, y, x) and r[3] is not None]
                want = (np.mean(v) if v else 0.0) if y < images[f][0] and x < images[f][1] else np.nan
                assert np.isclose(got[f, y // 8, x // 8][y % 8, x % 8], want, equal_nan=True, rtol=1e-12)


@pytest.mark.parametrize("name", ["lanczos_warp", "lattice_warp", "aperture_flux"])
def test_blocks_meet_by_merge_joins_without_rows_of_empty_pixels(spark, data, name):
    text = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert text.count("SortMergeJoin") == (2 if name == "aperture_flux" else 1)
    # The lattice's nodes meet the few images by broadcast.
    assert text.count("BroadcastHashJoin") == (1 if name == "lattice_warp" else 0)
    assert "avg(" not in text
