"""Odd inputs of the cohort and grid operators: empty tables, nulls, ties, repeated rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from framestack.operators import cohort, grids, registration


def test_largest_rectangle_against_all_rectangles(spark):
    rng = np.random.default_rng(9)
    rows, wanted = [], {}
    for g in range(6):
        mask = rng.random((7, 9)) < 0.72
        rows += [(g, int(y), int(x), bool(mask[y, x]) if (y + x) % 5 or mask[y, x] else None) for y in range(7) for x in range(9)]
        boxes = [((y1 - y0) * (x1 - x0), y0, x0, y1, x1) for y0, x0 in itertools.product(range(7), range(9)) for y1, x1 in itertools.product(range(y0 + 1, 8), range(x0 + 1, 10)) if mask[y0:y1, x0:x1].all()]
        wanted[g] = max(boxes)
    df = spark.createDataFrame(rows + rows[:5], "g int, y int, x int, ok boolean")
    got = {r["g"]: tuple(r)[1:] for r in grids.largest_rectangle(df, ["g"], "x", "y", F.col("ok")).collect()}
    assert {g: (a, y0, x0, y1, x1) for g, (a, y0, x0, y1, x1) in got.items()} == wanted
    assert grids.largest_rectangle(df.where("false"), ["g"], "x", "y", F.col("ok")).count() == 0


def test_lattice_rounds_halves_to_even(spark):
    got = grids.sample_lattice(spark.createDataFrame([(1, 6, 1), (2, 0, 4), (3, 1, 1)], "id int, h int, w int"), ["id"], "h", "w", 2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0), (1, 2, 0), (1, 5, 0), (3, 0, 0)]


def test_overrides_and_single_joins(spark):
    frames = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, None, "z")], "id int, digest string, gain string")
    over = spark.createDataFrame([("a", "new"), ("b", "new"), (None, "never")], "digest string, gain string")
    got = {r["id"]: (r["gain"], r["override_error"]) for r in cohort.overridden(frames, over, "digest", ["gain"]).collect()}
    assert got == {1: ("new", None), 2: ("x", "AMBIGUOUS"), 3: ("y", "AMBIGUOUS"), 4: ("z", None)}
    right = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "id int, v int")
    got = {r["id"]: (r["v"], r["join_error"]) for r in cohort.joined_once(frames.select("id"), right, ["id"]).collect()}
    assert got == {1: (10, None), 2: (None, "DUPLICATE"), 3: (None, "MISSING"), 4: (None, "MISSING")}
    codes = spark.createDataFrame([(["B", "A", None, "B"],), ([],)], "c array<string>").select(cohort.ordered_unique(F.col("c")).alias("c"))
    assert [r["c"] for r in codes.collect()] == [["B", "A"], []]


def test_registration_of_nothing(spark):
    stars = spark.createDataFrame([], "f string, id int, x double, y double, flux double")
    assert registration.register(stars, stars, ["f"], "id", "x", "y", "flux").count() == 0


def test_reference_without_an_allowed_frame(spark):
    rows = [("g", 1, 1.0, 5.0, 1.0, False), ("g", 2, 1.0, None, 1.0, None), ("h", 3, None, 2.0, 1.0, True), ("h", 4, 9.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "g string, id int, q double, span double, sky double, ok boolean")
    got = {r["g"]: r["reference"] for r in cohort.normalisation_reference(df, ["g"], "id", "q", "span", "sky", F.col("ok")).collect()}
    assert got == {"g": 1, "h": 3}
