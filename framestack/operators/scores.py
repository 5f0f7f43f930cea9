"""The score-based decision on frames: cloud, occlusion and shape scores with their reasons, to one decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import MADN, clean, over

# Weak and strong thresholds of the rule set.
DIMMING, STARS, EXTINCTION = (0.18, 0.45), (0.70, 0.45), (0.35, 0.45)
AREA, DENSITY, BOUNDARY, SUPPORT = (0.05, 0.15, 0.30), (0.35, 0.15), (0.50, 0.65), 0.50
BACKGROUND_Z, CLOUD_REJECT, OCCLUSION_STRONG = 3.0, 4, 5
# Ratio with z, z, and ratio alone of an outlier; the least value of a trailed frame.
HFR, FWHM, TRAILED, TRAILED_P90 = (1.08, 4.0, 1.15), (1.08, 4.0, 1.18), (1.20, 4.0, 1.50, 0.35), (1.15, 4.0, 1.40, 0.65)
FEATURES = ("dimming", "completeness", "source_ratio", "extinction", "background", "area", "density", "boundary", "support", "hfr", "fwhm", "ellipticity", "ellipticity_p90")


def _centred(df: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """df with the group's median `_c_` and MADN `_s_` of each name."""
    w = over(keys)
    df = df.withColumns({f"_c_{n}": F.percentile(n, F.lit(0.5)).over(w) for n in names})
    return df.withColumns({f"_s_{n}": MADN * F.percentile(F.abs(F.col(n) - F.col(f"_c_{n}")), F.lit(0.5)).over(w) for n in names})


def _outlier(name: str, ratio: float, z: float, alone: float, least: float | None = None) -> Column:
    v, c, s = F.col(name), F.col(f"_c_{name}"), F.col(f"_s_{name}")
    far = (v >= alone * c) | ((s > 1e-9) & (v >= ratio * c) & (v - c >= z * s))
    return F.coalesce((c > 0) & far & (F.lit(True) if least is None else v >= least), F.lit(False))


def _two(strong: Column, weak: Column, code: str, family: bool = True, when: Column | None = None) -> Column:
    """(points, family, strong, code) of a measure with two thresholds; nothing where it is unknown."""
    item = lambda points, hard, suffix: F.struct(F.lit(points).alias("points"), F.lit(int(family)).alias("family"), F.lit(hard and family).alias("strong"), F.lit(code + suffix).alias("code"))
    gate = F.lit(True) if when is None else when
    return F.when(gate & strong, item(2, True, "_STRONG")).when(gate & weak & ~strong, item(1, False, ""))


def scored_decisions(frames: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """frames with cloud_score, occlusion_score, shape_score, reasons (sorted) and decision.

    The frames hold FEATURES (NaN counts as unknown, an unknown feature gives no evidence) and a
    confidence HIGH, MEDIUM or another.  Only HIGH rejects; a missing source model makes a drop of
    sources count for review but never as a family of cloud evidence.
    """
    rows = frames.withColumns({n: clean(n) for n in FEATURES})
    rows = _centred(rows, keys, ("background", "hfr", "fwhm", "ellipticity", "ellipticity_p90"))
    c = F.col
    low = lambda n, pair: (c(n) <= pair[1], c(n) <= pair[0])
    high = lambda n, pair: (c(n) >= pair[1], c(n) >= pair[0])
    scatter = F.abs(c("background") - c("_c_background")) >= BACKGROUND_Z * F.greatest(c("_s_background"), F.lit(1e-8))
    cloud = F.array_compact(
        F.array(
            _two(*high("dimming", DIMMING), "CLOUD_SPATIAL_TRANSPARENCY"),
            _two(*low("completeness", STARS), "CLOUD_STAR_COMPLETENESS"),
            _two(*low("source_ratio", STARS), "SOURCE_COUNT_DROP_UNMODELED", False, c("extinction").isNull()),
            _two(*low("source_ratio", STARS), "CLOUD_SOURCE_COUNT", True, c("extinction") >= EXTINCTION[0]),
            _two(*high("extinction", EXTINCTION), "CLOUD_TEMPORAL_EXTINCTION"),
            F.when(scatter, F.struct(F.lit(1).alias("points"), F.lit(1).alias("family"), F.lit(False).alias("strong"), F.lit("CLOUD_BACKGROUND_SCATTER").alias("code"))),
        )
    )
    rows = rows.withColumn("_cloud", cloud)
    total = lambda field: F.aggregate("_cloud", F.lit(0), lambda s, e: s + e[field])
    area, boundary, support = (F.coalesce(c(n), F.lit(0.0)) for n in ("area", "boundary", "support"))
    thin = lambda most: F.coalesce(c("density") <= most, F.lit(False))
    large = area >= AREA[0]
    backed = support >= SUPPORT
    hard = (area >= AREA[1]) & thin(DENSITY[1]) & backed & (boundary >= BOUNDARY[1])
    vast = ~hard & (area >= AREA[2]) & thin(DENSITY[0]) & backed
    steps = {"OCC_LARGE_CONNECTED_REGION": large, "OCC_STAR_DENSITY_COLLAPSE": large & thin(DENSITY[0]), "OCC_BOUNDARY": large & (boundary >= BOUNDARY[0]), "OCC_BACKGROUND_OR_TEXTURE": large & backed}
    points = sum((s.cast("int") for s in steps.values()), F.lit(0))
    focus, trailed = _outlier("hfr", *HFR) | _outlier("fwhm", *FWHM), _outlier("ellipticity", *TRAILED) | _outlier("ellipticity_p90", *TRAILED_P90)
    named = steps | {"OCC_HARD_GEOMETRY_STRONG": hard, "OCC_VERY_LARGE_REGION_STRONG": vast, "SHAPE_FOCUS_OR_SEEING_OUTLIER": focus, "SHAPE_TRAILING_OUTLIER": trailed}
    rows = rows.withColumns(
        {
            "cloud_score": total("points"),
            "occlusion_score": F.when(hard | vast, F.greatest(points, F.lit(OCCLUSION_STRONG))).otherwise(points),
            "shape_score": F.when(trailed | _outlier("hfr", *HFR), 2).when(focus, 1).otherwise(0),
            "reasons": F.array_sort(F.concat(F.transform("_cloud", lambda e: e["code"]), F.array_compact(F.array(*[F.when(v, F.lit(n)) for n, v in named.items()])))),
            "_blocked": hard | vast,
        }
    )
    sure = F.coalesce(c(confidence) == "HIGH", F.lit(False))
    cloudy = (c("cloud_score") >= CLOUD_REJECT) & (total("family") >= 2) & F.exists("_cloud", lambda e: e["strong"])
    decision = (
        F.when(c("_blocked") & sure, "REJECT_OCCLUSION")
        .when(sure & cloudy, "REJECT_CLOUD")
        .when((c("cloud_score") >= 2) | (c("occlusion_score") >= 2) | (c("shape_score") >= 2), "REVIEW")
        .when(F.coalesce(c(confidence).isin("MEDIUM", "HIGH"), F.lit(False)), "KEEP")
        .otherwise("UNASSESSABLE")
    )
    return rows.withColumn("decision", decision).select(*frames.columns, "cloud_score", "occlusion_score", "shape_score", "reasons", "decision")
