"""The quality gate: each frame's evidence by family, out of its own measures, its night's other frames and its cohort.

evaluate() takes one row a measured frame with the columns of FRAME (missing ones count as null) and adds
gate_codes (the worst finding of each family, by family name) and disposition.  Findings are struct
expressions; a family's worst is the greatest of its structs, so a frame's evidence never leaves its row.
Peer statistics leave the frame itself out by ranks, without a self-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import cut
from .stats import MADN, clean, envelope, pair_slopes
from .windows import without_self

#: Columns of a frame that the gate reads, beside the keys that evaluate() names.
FRAME = {
    "reference": "string", "role": "string", "status": "string", "error_code": "string", "identity": "string", "result_identity": "string",
    "finite_fraction": "double", "dynamic_range": "double", "image_median": "double", "image_mad": "double", "texture": "double", "source_count": "double",
    "registration_ok": "boolean", "matched_stars": "long", "match_fraction": "double", "rms": "double", "overlap": "double", "field_coverage": "double",
    "transparency": "double", "airmass": "double", "extra_extinction": "double", "dimming": "double", "completeness": "double", "source_ratio": "double",
    "shape_stars": "long", "hfr": "double", "fwhm": "double", "ellipticity": "double", "ellipticity_p90": "double", "elongated": "double", "coherence": "double", "fragmented": "boolean",
    "missing_area": "double", "missing_density": "double", "boundary_support": "double", "background_support": "double",
}

# Severities by rank, and the thresholds of the rule set.
SEVERITIES = ("INFO", "WARNING", "REVIEW", "ERROR", "HARD_FAIL")
REVIEW, ERROR, HARD = 2, 3, 4
POLICY = {
    "cohort_frames": 8, "night_frames": 3, "matches": 30, "match_fraction": 0.25, "rms": 1.5, "overlap": 0.50, "field_coverage": 0.85, "sources": 20, "shape_stars": 15,
    "finite_review": 0.999, "finite_hard": 0.95, "dimming_weak": 0.18, "dimming_strong": 0.45, "extinction_weak": 0.35, "extinction_strong": 0.45, "extinction_thick": 1.5,
    "night_shift": 0.50, "retention_weak": 0.70, "retention_strong": 0.45, "background_z": 4.0, "background_z_strong": 6.0, "background_ratio": 0.25, "background_ratio_strong": 0.50,
    "noise_z": 4.0, "noise_low": 0.55, "noise_high": 1.80, "focus_ratio": 1.12, "focus_z": 3.5, "focus_delta": 0.25, "focus_alone": 1.30, "night_hfr": 1.15, "night_fwhm": 1.12,
    "trail_median": 0.30, "trail_p90": 0.55, "trail_coherence": 0.25, "trail_relative": 1.20, "smear_median": 0.45, "smear_fraction": 0.60, "smear_coherence": 0.75, "smear_relative": 1.50, "smear_stars": 30,
    "area_weak": 0.05, "area_strong": 0.15, "area_large": 0.30, "density_weak": 0.35, "density_strong": 0.15, "boundary_weak": 0.50, "boundary_strong": 0.65, "background_support": 0.50,
}
#: Nights with fewer other frames borrow the cohort's spread; a spread is at least this share of its center.
FEW_PEERS, LEAST_SPREAD = 5, 0.02
#: Pairs of a night's frames closer in airmass, or steeper, say nothing of the atmosphere; the slope's physical range.
LEAST_AIRMASS_STEP, STEEPEST, SLOPES = 0.05, 2.0, (0.0, 1.0)
SERIES = ("background", "noise", "hfr", "fwhm", "ellipticity")


def with_frame_columns(df: DataFrame) -> DataFrame:
    """df with every column of FRAME, numbers without NaN and infinities."""
    cast = lambda n, t: clean(n) if t == "double" else F.col(n).cast(t)
    return df.withColumns({n: cast(n, t) if n in df.columns else F.lit(None).cast(t) for n, t in FRAME.items()})


def peer_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with <value>_low, _center, _high and _spread (MADN) of the group's other rows, null for rows without a value.

    Without one row a group's median is one of at most three values; deviations are ranked about each of
    them, in rows that are already together.
    """
    names = [f"{value}_{n}" for n in ("low", "center", "high")]
    known = F.col(value).isNotNull() & F.col(keys[-1]).isNotNull()
    rows = without_self(df, keys, value).withColumnsRenamed(dict(zip(("peer_low", "peer_median", "peer_high"), names, strict=True)))
    rows = rows.withColumns({n: F.when(known, F.col(n)) for n in names})
    rows = rows.withColumn("_all", F.collect_set(names[1]).over(Window.partitionBy(*keys)))
    about = F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(F.lit(None).cast("double")))
    dealt = rows.withColumns({"_least": F.array_min("_all"), "_about": F.explode(about)}).withColumn("_off", F.abs(F.col(value) - F.col("_about")))
    own = without_self(dealt, [*keys, "_about"], "_off").where(F.coalesce(names[1], "_least").eqNullSafe(F.col("_about")))
    return own.withColumn(f"{value}_spread", F.when(known, MADN * F.col("peer_median"))).drop("_all", "_least", "_about", "_off", "peer_low", "peer_median", "peer_high")


def nightly_fit(df: DataFrame, cohort: str, night: str, airmass: str, extinction: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(cohort, slope, reliable, best_offset) of cohorts, and (cohort, night, night_offset) of their nights.

    The slope is the median over pairs of one night, clamped to SLOPES; a night's offset is the envelope
    of its lowest tenth without the slope's share.  Rows without airmass, extinction or night do not count.
    """
    x, y = clean(airmass), clean(extinction)
    known = df.select(F.col(cohort), F.col(night), x.alias("x"), y.alias("y"), F.col(order).alias("o")).where(F.col(night).isNotNull() & (F.col("x") > 0) & F.col("y").isNotNull())
    fit = pair_slopes(known.where(F.col(cohort).isNotNull()), [cohort], night, "x", "y", LEAST_AIRMASS_STEP, STEEPEST).withColumnRenamed("slope", "raw")
    spans = known.groupBy(cohort, night).agg(F.count("*").alias("k"), (F.max("x") - F.min("x")).alias("span")).groupBy(cohort).agg(F.sum("k").alias("valid"), F.max(F.when(F.col("k") > 1, F.col("span"))).alias("span"))
    sound = (F.col("valid") >= 4) & (F.col("pairs") >= 3) & (F.col("span") >= 0.20) & F.col("raw").between(*SLOPES)
    model = cut(spans.join(fit, cohort, "left").select(cohort, F.least(F.greatest("raw", F.lit(SLOPES[0])), F.lit(SLOPES[1])).alias("slope"), F.coalesce(sound, F.lit(False)).alias("reliable")))
    flat = known.join(model.where("slope is not null"), cohort).withColumn("flat", F.col("y") - F.col("slope") * (F.col("x") - 1))
    offsets = cut(envelope(flat, [cohort, night], "flat").select(cohort, night, F.col("envelope").alias("night_offset")))
    best = offsets.groupBy(cohort).agg(F.when(F.count("*") >= 2, F.min("night_offset")).alias("best_offset"))
    return model.join(best, cohort, "left"), offsets


def finding(code: str, rank: int, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(rank).alias("rank"), F.lit(f"GATE_{code}").alias("code")))


def worst(*findings: Column) -> Column:
    """The finding of the highest severity, then of the last code; null without any."""
    return F.greatest(*findings) if len(findings) > 1 else findings[0]


def _anomaly(value: str, center: Column) -> tuple[Column, Column, Column]:
    """Ratio, difference and z of a value against a center, by the spread of its night's other frames."""
    v, spread = F.col(value), F.col(f"{value}_scale")
    floor = F.greatest(F.abs(center) * LEAST_SPREAD, F.lit(1e-9))
    return F.when(F.abs(center) > 1e-12, v / center), v - center, (v - center) / F.when(spread > 0, spread).otherwise(floor)


def _at_least(n: int, *conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(False)).cast("int") for c in conditions)) >= n


def with_history(df: DataFrame, cohort: str, night: str, path: str) -> DataFrame:
    """df with all that the findings need of other frames: peers, cohort spreads, extinction fit, night envelopes, reference edges."""
    # Written once: every statistic below reads it anew, and none reads another's joins.
    base = cut(with_frame_columns(df).withColumns({
        "background": F.col("image_median"),
        "noise": F.coalesce(F.nullif("texture", F.lit(0.0)), F.col("image_mad")),
        "extinction": F.when(F.col("transparency") > 0, -2.5 * F.log10("transparency")),
    }))
    keys = [cohort, night]
    middle = base.groupBy(cohort).agg(F.count("*").alias("cohort_size"), *[F.percentile(n, F.lit(0.5)).alias(f"{n}_mid") for n in SERIES], F.when(F.count("extinction") >= 4, F.percentile("extinction", F.lit(0.05))).alias("clear_zero"))
    off = lambda n: F.percentile(F.abs(F.col(n) - F.col(f"{n}_mid")), F.lit(0.5))
    wide = base.join(middle, cohort).groupBy(cohort).agg(F.max("cohort_size").alias("cohort_size"), F.max("clear_zero").alias("clear_zero"), *[F.when(F.count(n) >= 2, MADN * off(n)).alias(f"{n}_wide") for n in SERIES])
    model, offsets = nightly_fit(base, cohort, night, "airmass", "extinction", path)
    cohorts = wide.join(model, cohort, "left")
    nights = offsets
    for name in ("hfr", "fwhm"):
        low = cut(envelope(base.where(F.col(night).isNotNull()), keys, name).select(cohort, night, F.col("envelope").alias(f"night_{name}")))
        best = low.groupBy(cohort).agg(F.when(F.count("*") >= 2, F.min(f"night_{name}")).alias(f"best_{name}"))
        nights, cohorts = nights.join(low, keys, "full"), cohorts.join(best, cohort, "left")
    edge = F.struct("registration_ok", "matched_stars", "match_fraction", "rms")
    good = F.struct("matched_stars", "match_fraction", -F.coalesce("rms", F.lit(float("inf"))))
    edges = base.where(F.col("registration_ok") & (F.col(path) != F.col("reference"))).groupBy(F.col(cohort).alias("_c"), F.col("reference").alias("_of")).agg(F.max_by(edge, good).alias("peer_edge"))
    of = base.select(F.col(cohort).alias("_c"), F.col(path).cast("string").alias("_of"), F.col(night).alias("reference_night")).join(base.select(F.col("reference").alias("_of")).distinct(), "_of", "left_semi")

    rows = base.withColumns({"night_size": F.count(night).over(Window.partitionBy(*keys)), **{f"{n}_n": F.count(n).over(Window.partitionBy(*keys)) - 1 for n in SERIES}})
    for name in SERIES:
        rows = peer_spread(rows, keys, name)
    rows = without_self(rows, keys, "source_count").withColumn("source_high", F.when(F.col("source_count").isNotNull() & F.col(night).isNotNull(), F.col("peer_high"))).drop("peer_low", "peer_median", "peer_high")
    rows = rows.join(cut(nights), keys, "left").join(cut(cohorts), cohort)
    own = lambda n: F.greatest(F.col(f"{n}_spread"), F.abs(f"{n}_center") * LEAST_SPREAD, F.when(F.col(f"{n}_n") < FEW_PEERS, F.col(f"{n}_wide")))
    flat = F.when((clean("airmass") > 0) & F.col(night).isNotNull(), F.col("extinction") - F.col("slope") * (F.col("airmass") - 1))
    rows = rows.withColumns({f"{n}_scale": F.when(own(n) > 1e-9, own(n)) for n in SERIES} | {"residual": flat - F.col("night_offset"), "reliable": F.coalesce("reliable", F.lit(False))})
    rows = rows.join(edges, (F.col(cohort) == F.col("_c")) & (F.col(path).cast("string") == F.col("_of")), "left").drop("_c", "_of")
    return rows.join(of, (F.col(cohort) == F.col("_c")) & (F.col("reference") == F.col("_of")), "left").drop("_c", "_of")


def evaluate(df: DataFrame, cohort: str = "cohort", night: str = "night", path: str = "path") -> DataFrame:
    """df with gate_codes (array, by family name) and disposition (HARD_FAIL, REVIEW or PASS)."""
    p, c = POLICY, F.col
    rows = with_history(df, cohort, night, path)
    is_reference = F.coalesce(c(path).cast("string") == c("reference"), F.lit(False))
    edge = lambda n: F.when(is_reference & c("peer_edge").isNotNull(), c(f"peer_edge.{n}")).otherwise(c(n))
    rows = rows.withColumns({f"edge_{n}": edge(n) for n in ("registration_ok", "matched_stars", "match_fraction", "rms")})
    registered = F.coalesce(c("edge_registration_ok") & (c("edge_matched_stars") >= p["matches"]) & (c("edge_match_fraction") >= p["match_fraction"]) & (c("edge_rms") <= p["rms"]), F.lit(False))
    inferred = F.coalesce(c("overlap").isNull() & c("edge_registration_ok") & (c("edge_matched_stars") >= p["matches"]) & (c("edge_match_fraction") >= 0.75), F.lit(False))
    nightly = c("reliable") & c("residual").isNotNull()
    excess = F.when(nightly, c("residual")).otherwise(F.coalesce("extra_extinction", c("extinction") - c("clear_zero")))
    uncorrected = ~nightly & c("extra_extinction").isNull()
    explained = nightly & (c("residual") < p["extinction_weak"])
    same_night = F.coalesce(c("reference_night") == c(night), F.lit(False))
    retention = F.least("completeness", F.when(~explained & same_night, c("source_ratio")), F.when(~explained & (c("source_high") != 0), c("source_count") / c("source_high")))
    rows = rows.withColumns({"registered": registered, "excess": excess, "uncorrected": uncorrected, "retention": retention})

    measured = c("status").isNotNull()
    ff, dr = c("finite_fraction"), c("dynamic_range")
    background, noise, hfr, fwhm = _anomaly("background", c("background_center")), _anomaly("noise", c("noise_center")), _anomaly("hfr", c("hfr_low")), _anomaly("fwhm", c("fwhm_low"))
    abnormal = lambda a: F.coalesce((a[0] >= p["focus_ratio"]) & (a[1] >= p["focus_delta"]) & (a[2] >= p["focus_z"]), F.lit(False))
    alone = lambda a: F.coalesce(a[0] >= p["focus_alone"], F.lit(False))
    over = lambda a, b, floor: F.when(c(b).isNotNull(), c(a) / F.greatest(b, F.lit(floor)))
    night_fwhm, night_hfr = over("night_fwhm", "best_fwhm", 1e-9), over("night_hfr", "best_hfr", 1e-9)
    both_soft = F.coalesce((night_hfr >= p["night_hfr"]) & (night_fwhm >= p["night_fwhm"]), F.lit(False))
    one_soft = F.coalesce((night_fwhm >= p["focus_alone"]) & (c("night_fwhm") - c("best_fwhm") >= p["focus_delta"]), F.lit(False))
    relative = over("ellipticity", "ellipticity_center", 1e-6)
    smear = F.coalesce((c("shape_stars") >= p["smear_stars"]) & (c("ellipticity") >= p["smear_median"]) & (c("elongated") >= p["smear_fraction"]) & (c("coherence") >= p["smear_coherence"]) & (relative >= p["smear_relative"]), F.lit(False))
    long = _at_least(1, c("ellipticity") >= p["trail_median"], c("ellipticity_p90") >= p["trail_p90"])
    optical = F.coalesce((c("coherence") < p["trail_coherence"]) & (relative < p["trail_relative"]) & (c("ellipticity") < p["smear_median"]), F.lit(False))
    area, density, edge_support, back = F.coalesce("missing_area", F.lit(0.0)), c("missing_density"), F.coalesce("boundary_support", F.lit(0.0)), F.coalesce("background_support", F.lit(0.0))
    backed = back >= p["background_support"]
    blocked = _at_least(1, (area >= p["area_strong"]) & (density <= p["density_strong"]) & (edge_support >= p["boundary_strong"]) & backed, (area >= p["area_large"]) & (density <= p["density_weak"]) & backed)
    half_blocked = ~blocked & (area >= p["area_weak"]) & _at_least(2, density <= p["density_weak"], edge_support >= p["boundary_weak"], backed)
    shape_stars = F.coalesce("shape_stars", F.lit(0))
    zr = lambda a, z, d: (F.abs(a[2]) >= z) & (F.abs(a[0] - 1) >= d)
    rows = rows.withColumns({
        "f_identity": worst(
            finding("MEASUREMENT_MISSING", HARD, ~measured),
            finding("MEASUREMENT_FAILED", HARD, measured & ((c("status") != "MEASURED") | (F.coalesce("error_code", F.lit("")) != ""))),
            finding("IDENTITY_MISSING", HARD, measured & (c("identity").isNull() | c("result_identity").isNull())),
            finding("IDENTITY_MISMATCH", HARD, measured & (c("identity") != c("result_identity"))),
        ),
        "f_role": finding("NOT_A_LIGHT_FRAME", HARD, measured & ~c("role").eqNullSafe("LIGHT")),
        "f_pixels": F.when(measured, worst(
            finding("FINITE_FRACTION_MISSING", REVIEW, ff.isNull()),
            finding("FINITE_FRACTION_INVALID", HARD, ~ff.between(0, 1)),
            finding("FINITE_FRACTION_HARD", HARD, ff.between(0, 1) & (ff < p["finite_hard"])),
            finding("FINITE_FRACTION_REVIEW", REVIEW, (ff >= p["finite_hard"]) & (ff < p["finite_review"])),
            finding("DYNAMIC_RANGE_MISSING", REVIEW, dr.isNull()),
            finding("NEAR_CONSTANT_IMAGE", HARD, dr <= F.greatest(F.lit(1e-8), F.abs(F.coalesce("image_median", F.lit(0.0))) * 1e-8)),
        )),
        "f_metadata": finding("NIGHT_UNRESOLVED", REVIEW, c(night).isNull()),
        "f_provenance": worst(finding("INSUFFICIENT_COHORT", REVIEW, c("cohort_size") < p["cohort_frames"]), finding("INSUFFICIENT_NIGHT_BASELINE", REVIEW, c(night).isNotNull() & (c("night_size") < p["night_frames"]))),
        "f_registration": worst(
            finding("REFERENCE_NOT_CONNECTED", REVIEW, is_reference & c("peer_edge").isNull()),
            finding("REGISTRATION_REVIEW", REVIEW, ~c("registered")),
            finding("COMMON_FOOTPRINT_REVIEW", REVIEW, ~inferred & (c("overlap").isNull() | (c("overlap") < p["overlap"]))),
            finding("FIELD_OFFSET_HARD", HARD, c("field_coverage") < p["field_coverage"]),
        ),
        "f_transparency": worst(
            finding("TEMPORAL_EXTINCTION_STRONG", ERROR, c("excess") >= p["extinction_thick"]),
            finding("TEMPORAL_EXTINCTION_INFO", 0, (c("excess") >= p["extinction_weak"]) & (c("excess") < p["extinction_thick"])),
            finding("NIGHT_ZEROPOINT_SHIFT_REVIEW", REVIEW, c("reliable") & (c("night_offset") - c("best_offset") >= p["night_shift"])),
        ),
        "f_consensus": worst(
            finding("SPATIAL_DIMMING_STRONG", ERROR, c("dimming") >= p["dimming_strong"]),
            finding("SPATIAL_DIMMING_REVIEW", REVIEW, (c("dimming") >= p["dimming_weak"]) & (c("dimming") < p["dimming_strong"])),
            finding("SOURCE_RETENTION_STRONG", ERROR, c("retention") <= p["retention_strong"]),
            finding("SOURCE_RETENTION_REVIEW", REVIEW, (c("retention") > p["retention_strong"]) & (c("retention") <= p["retention_weak"])),
            finding("ABSOLUTE_LOW_SOURCE_COUNT", REVIEW, c("source_count") < p["sources"]),
            finding("SOURCE_COUNT_MISSING", REVIEW, c("source_count").isNull()),
        ),
        "f_background": worst(
            finding("BACKGROUND_STRONG", ERROR, zr(background, p["background_z_strong"], p["background_ratio_strong"])),
            finding("BACKGROUND_REVIEW", REVIEW, zr(background, p["background_z"], p["background_ratio"]) & ~zr(background, p["background_z_strong"], p["background_ratio_strong"])),
            finding("NOISE_REVIEW", REVIEW, ((noise[0] <= p["noise_low"]) | (noise[0] >= p["noise_high"])) & (F.abs(noise[2]) >= p["noise_z"])),
        ),
        "f_morphology": worst(
            finding("MORPHOLOGY_SAMPLE_REVIEW", REVIEW, shape_stars < p["shape_stars"]),
            finding("FOCUS_SEEING_REVIEW", REVIEW, (abnormal(hfr) & abnormal(fwhm)) | alone(hfr) | alone(fwhm)),
            finding("NIGHT_FOCUS_SHIFT_REVIEW", REVIEW, c(night).isNotNull() & (both_soft | one_soft)),
            finding("FRAGMENTED_TRAILING_HARD", HARD, c("fragmented")),
            finding("COHERENT_TRAILING_HARD", HARD, smear),
            finding("SHARED_ELONGATION_INFO", 0, ~smear & long & optical),
            finding("TRAILING_REVIEW", REVIEW, ~smear & long & ~optical),
        ),
        "f_occlusion": worst(finding("OCCLUSION_HARD", HARD, blocked), finding("OCCLUSION_REVIEW", REVIEW, half_blocked)),
    })

    # Thin cloud counts where spatial or background evidence agrees; then two families of cloud, one of them strong, fail.
    clouded = F.coalesce(c("f_background.rank") >= REVIEW, F.lit(False))
    agreed = (c("excess") >= p["extinction_weak"]) & (c("excess") < p["extinction_thick"]) & (F.coalesce(c("dimming") >= p["dimming_weak"], F.lit(False)) | clouded)
    strong = (c("excess") >= p["extinction_strong"]) & ~c("uncorrected")
    rows = rows.withColumn("f_transparency", worst(c("f_transparency"), finding("TEMPORAL_EXTINCTION_STRONG", ERROR, agreed & strong), finding("TEMPORAL_EXTINCTION_REVIEW", REVIEW, agreed & ~strong)))
    cloudy = {
        "f_consensus": c("f_consensus.code").startswith("GATE_SPATIAL_DIMMING_") | c("f_consensus.code").startswith("GATE_SOURCE_RETENTION_"),
        "f_transparency": c("f_transparency.code").startswith("GATE_TEMPORAL_EXTINCTION_"),
        "f_background": c("f_background.code").isNotNull(),
    }
    seen = [F.when(ok & (c(f"{f}.rank") >= REVIEW), c(f"{f}.rank")) for f, ok in cloudy.items()]
    failed = (c("cohort_size") >= p["cohort_frames"]) & c("registered") & _at_least(2, *[s.isNotNull() for s in seen]) & (F.greatest(*seen) >= ERROR)
    rows = rows.withColumn("f_transparency", worst(c("f_transparency"), finding("MULTI_FAMILY_CLOUD_HARD", HARD, failed)))
    families = ["f_background", "f_consensus", "f_identity", "f_metadata", "f_morphology", "f_occlusion", "f_pixels", "f_provenance", "f_registration", "f_role", "f_transparency"]
    top = F.greatest(*[c(f"{f}.rank") for f in families])
    codes = F.array_compact(F.array(*[c(f"{f}.code") for f in families]))
    return rows.select(*df.columns, codes.alias("gate_codes"), F.when(top >= HARD, "HARD_FAIL").when(top >= REVIEW, "REVIEW").otherwise("PASS").alias("disposition"), "residual", "reliable")
