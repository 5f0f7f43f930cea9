"""Cases of the decision by hand, beside the query's SQL."""

from framestack.operators import scores

CLEAR = {"dimming": 0.05, "completeness": 0.95, "source_ratio": 0.95, "extinction": 0.0, "background": 100.0, "area": 0.0, "density": 1.0, "boundary": 0.0, "support": 0.0, "hfr": 2.0, "fwhm": 3.0, "ellipticity": 0.2, "ellipticity_p90": 0.4}
CASES = {
    "clear": ({}, "HIGH", "KEEP", []),
    "unsure": ({}, "LOW", "UNASSESSABLE", []),
    "nothing known": (dict.fromkeys(CLEAR), None, "UNASSESSABLE", []),
    "not a number": ({"dimming": float("nan"), "area": float("nan")}, "MEDIUM", "KEEP", []),
    "cloud": ({"dimming": 0.5, "completeness": 0.4}, "HIGH", "REJECT_CLOUD", ["CLOUD_SPATIAL_TRANSPARENCY_STRONG", "CLOUD_STAR_COMPLETENESS_STRONG"]),
    "cloud, unsure": ({"dimming": 0.5, "completeness": 0.4}, "MEDIUM", "REVIEW", ["CLOUD_SPATIAL_TRANSPARENCY_STRONG", "CLOUD_STAR_COMPLETENESS_STRONG"]),
    "drop without a model": ({"source_ratio": 0.4, "extinction": None, "dimming": 0.5}, "HIGH", "REVIEW", ["CLOUD_SPATIAL_TRANSPARENCY_STRONG", "SOURCE_COUNT_DROP_UNMODELED_STRONG"]),
    "drop that a model explains": ({"source_ratio": 0.4}, "HIGH", "KEEP", []),
    "wall": ({"area": 0.2, "density": 0.1, "boundary": 0.7, "support": 0.6}, "HIGH", "REJECT_OCCLUSION", ["OCC_BACKGROUND_OR_TEXTURE", "OCC_BOUNDARY", "OCC_HARD_GEOMETRY_STRONG", "OCC_LARGE_CONNECTED_REGION", "OCC_STAR_DENSITY_COLLAPSE"]),
    "one bare cell": ({"area": 0.01, "density": 0.0, "boundary": 1.0, "support": 1.0}, "HIGH", "KEEP", []),
    "unfocused": ({"hfr": 2.5}, "HIGH", "REVIEW", ["SHAPE_FOCUS_OR_SEEING_OUTLIER"]),
    "soft": ({"fwhm": 3.9}, "HIGH", "KEEP", ["SHAPE_FOCUS_OR_SEEING_OUTLIER"]),
    "trailed": ({"ellipticity": 0.4}, "HIGH", "REVIEW", ["SHAPE_TRAILING_OUTLIER"]),
    "bright": ({"background": 900.0}, "HIGH", "KEEP", ["CLOUD_BACKGROUND_SCATTER"]),
}


def test_decisions(spark):
    rows = [(name, *[(CLEAR | own)[k] for k in scores.FEATURES], sure) for name, (own, sure, _, _) in CASES.items()]
    schema = "name string, " + ", ".join(f"{k} double" for k in scores.FEATURES) + ", confidence string"
    got = {r["name"]: r for r in scores.scored_decisions(spark.createDataFrame(rows, schema), [], "confidence").collect()}
    assert {k: (r["decision"], r["reasons"]) for k, r in got.items()} == {k: (d, why) for k, (_, _, d, why) in CASES.items()}
    assert got["wall"]["occlusion_score"] == 5 and got["cloud"]["cloud_score"] == 4 and got["soft"]["shape_score"] == 1
