"""Labels of sparse pixels, against those of whole blocks."""

import random

import pytest

from framestack.operators import blocks


@pytest.mark.parametrize("diagonal", [False, True])
def test_parts_of_points_equal_those_of_blocks(spark, diagonal):
    pick = random.Random(2)
    rows = [(k, pick.randrange(40), pick.randrange(70), pick.choice([1.0, 5.0, 9.0, None, float("nan"), float("inf")])) for k in ("a", None, "b") for _ in range(2600)]
    rows += [("snake", y, x, 9.0) for y in range(0, 33) for x in range(33) if y % 2 == 0 or x == (32 if y % 4 == 1 else 0)]
    rows += [("a", -1, 3, 9.0), ("low", 1, 1, 0.0)]
    pixels = spark.createDataFrame(rows, "k string, y long, x long, v double")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = blocks.label_points(pixels, ["k"], "y", "x", "v", 4.0, 16, diagonal, tasks=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = blocks.label_parts(blocks.from_pixels(pixels, ["k"], "y", "x", "v", 16), ["k"], 4.0, 16, diagonal=diagonal).collect()
    plain = lambda r: (str(r.k), *r[1:-1], tuple(sorted((p.y, p.x) for p in r.rim)))
    assert sorted(map(plain, got)) == sorted(map(plain, want))
    assert len(got) > 100
