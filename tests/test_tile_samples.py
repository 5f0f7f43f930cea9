"""The tile query shuffles samples, not bands that are mostly empty."""

from framestack.catalogue import QUERIES


def test_tiles_make_no_dense_bands_before_their_shuffle(spark, data):
    text = QUERIES["stack_tile_udf"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FlatMapGroupsInArrow") == 1
