"""The shape of the physical plans: shuffles, pushed filters, pruned columns."""

import re

import pytest

from framestack.catalogue import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", text))


# The whole gate shuffles by cohort and night, by reference, and the frames that are references.
@pytest.mark.parametrize("name, most", [("stack_clip_mean", 1), ("stack_irls_huber", 1), ("leave_one_out_mean", 1), ("weights_normalised", 1), ("gap_blocks", 1), ("topk_per_group", 1), ("soft_guard", 1), ("group_share_guard", 1), ("gate_family_max", 3), ("night_baseline", 1), ("drizzle_splat", 1), ("blend_taper", 1), ("reference_choice", 1), ("pixel_stats_partial", 1), ("frame_expression", 0), ("sky_arithmetic", 0), ("relaxed_candidates", 1)])
def test_shuffles(spark, data, name, most):
    text = plan(QUERIES[name](spark, data))
    assert shuffles(text) <= most, text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "CartesianProduct" not in text


def test_scans_read_only_what_is_used(spark, data):
    text = plan(QUERIES["stack_clip_mean"](spark, data))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_extendedprice", "l_partkey", "l_quantity"]


def test_filters_reach_the_scan(spark, data):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(l_quantity,20", plan(QUERIES["cache_missing"](spark, data)))
    # The envelope fits every event: no filter on the type may come back.
    assert "EqualTo(event_type" not in plan(QUERIES["extinction_envelope"](spark, data))


def test_no_query_has_a_cartesian_product(spark, data):
    for name in ("mutual_nn", "radius_pairs", "overlap_boxes", "isolation_antijoin", "offset_mode", "trail_corridor", "triangles", "best_calibration_match", "polygon_overlap", "lattice_warp", "aperture_flux"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, data)), name


def test_a_warp_joins_once_and_shuffles_its_output_blocks_once(spark):
    """Source blocks and windows meet by hash, output blocks are one more shuffle; windows are never broadcast unchecked."""
    from framestack.operators import blocks

    images = spark.createDataFrame([("a", 64, 64, 64, 64, [1.0, 0.0, 0.5, 0.0, 1.0, 0.5, 0.0, 0.0, 1.0])], "f string, height int, width int, out_height int, out_width int, m array<double>")
    held = spark.createDataFrame([("a", 0, 0, bytearray(8 * 64 * 64))], "f string, by int, bx int, data binary")
    text = plan(blocks.warp(held, blocks.matrix_windows(images, ["f"], 64), ["f"], 64))
    assert shuffles(text) <= 3 and "CartesianProduct" not in text and "NestedLoop" not in text, text
