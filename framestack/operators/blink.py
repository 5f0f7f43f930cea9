"""Flags of frames against their channel, the gate's findings told as flags, default decisions and night summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import best_low, clean

# Thresholds, flags by finding of the gate, and findings that only say that evidence is missing.
POLICY = {
    "clean_extinction": 0.35, "clean_sources": 0.60, "clean_frames": 3, "sky": 1.6, "sky_sources": 0.60, "sources": 0.60, "sources_few": 0.45, "extinction": 0.50, "extinction_strong": 1.00,
    "shape": 0.50, "gradient": 2.0, "gradient_strong": 3.0, "fwhm": 1.30, "fwhm_strong": 1.60, "elongated": 0.30, "few_stars": 20,
}
GATE_FLAGS = {
    "GATE_COHERENT_TRAILING_HARD": ("BLINK_TRAILING", "EXCLUDE"),
    "GATE_FRAGMENTED_TRAILING_HARD": ("BLINK_TRAILING", "EXCLUDE"),
    "GATE_TRAILING_REVIEW": ("BLINK_TRAILING", "ATTENTION"),
    "GATE_FOCUS_SEEING_REVIEW": ("BLINK_FOCUS", "ATTENTION"),
    "GATE_NIGHT_FOCUS_SHIFT_REVIEW": ("BLINK_FOCUS", "ATTENTION"),
    "GATE_OCCLUSION_HARD": ("BLINK_OBSTRUCTION", "EXCLUDE"),
    "GATE_OCCLUSION_REVIEW": ("BLINK_OBSTRUCTION", "ATTENTION"),
    "GATE_SPATIAL_DIMMING_STRONG": ("BLINK_CLOUD_PATCHY", "EXCLUDE"),
    "GATE_SPATIAL_DIMMING_REVIEW": ("BLINK_CLOUD_PATCHY", "ATTENTION"),
    "GATE_MULTI_FAMILY_CLOUD_HARD": ("BLINK_CLOUD_THICK", "EXCLUDE"),
    "GATE_SOURCE_RETENTION_STRONG": ("BLINK_SOURCES_LOW", "ATTENTION"),
    "GATE_SOURCE_RETENTION_REVIEW": ("BLINK_SOURCES_LOW", "ATTENTION"),
    "GATE_FIELD_OFFSET_HARD": ("BLINK_FIELD_MISMATCH", "EXCLUDE"),
    "GATE_COMMON_FOOTPRINT_REVIEW": ("BLINK_FIELD_MISMATCH", "ATTENTION"),
    "GATE_REGISTRATION_REVIEW": ("BLINK_REGISTRATION_WEAK", "ATTENTION"),
    "GATE_BACKGROUND_STRONG": ("BLINK_NIGHT_OUTLIER", "ATTENTION"),
    "GATE_BACKGROUND_REVIEW": ("BLINK_NIGHT_OUTLIER", "ATTENTION"),
    "GATE_NOISE_REVIEW": ("BLINK_NIGHT_OUTLIER", "ATTENTION"),
    "GATE_MEASUREMENT_FAILED": ("BLINK_UNMEASURABLE", "EXCLUDE"),
    "GATE_MEASUREMENT_MISSING": ("BLINK_UNMEASURABLE", "EXCLUDE"),
    "GATE_IDENTITY_MISSING": ("BLINK_UNMEASURABLE", "EXCLUDE"),
    "GATE_IDENTITY_MISMATCH": ("BLINK_UNMEASURABLE", "EXCLUDE"),
    "GATE_FINITE_FRACTION_HARD": ("BLINK_UNMEASURABLE", "EXCLUDE"),
    "GATE_FINITE_FRACTION_INVALID": ("BLINK_UNMEASURABLE", "EXCLUDE"),
    "GATE_NEAR_CONSTANT_IMAGE": ("BLINK_UNMEASURABLE", "EXCLUDE"),
    "GATE_NOT_A_LIGHT_FRAME": ("BLINK_UNMEASURABLE", "EXCLUDE"),
}
NOTES = (
    "GATE_INSUFFICIENT_COHORT", "GATE_INSUFFICIENT_NIGHT_BASELINE", "GATE_NIGHT_UNRESOLVED", "GATE_MORPHOLOGY_SAMPLE_REVIEW", "GATE_SOURCE_COUNT_MISSING",
    "GATE_FINITE_FRACTION_REVIEW", "GATE_FINITE_FRACTION_MISSING", "GATE_DYNAMIC_RANGE_MISSING", "GATE_REFERENCE_NOT_CONNECTED",
)


def channels(df: DataFrame, channel: str = "channel") -> DataFrame:
    """(channel, frames, clean_frames, sources_best, fwhm_best, sky_clean, gradient_clean) of frames.

    Frames have stars, fwhm, sky, extinction, registration_ok, disposition, gradient and transparency.  Those that
    fail the gate count in `frames` only; the clean set is registered, with little extinction and many stars.
    """
    sound = ~F.col("disposition").eqNullSafe("HARD_FAIL")
    stars, fwhm = F.when(sound & (F.col("stars") > 0), F.col("stars").cast("double")), F.when(sound & (clean("fwhm") > 0), clean("fwhm"))
    # Only the clean set needs the best count; both are aggregates, so the frames are read twice but never sorted.
    best = df.groupBy(channel).agg(
        F.count("*").alias("frames"),
        F.when(F.count(stars) >= 10, F.percentile(stars, F.lit(0.9))).otherwise(F.max(stars)).alias("sources_best"),
        best_low(fwhm).alias("fwhm_best"),
    )
    rows = df.join(best.select(F.col(channel).alias("_c"), F.col("sources_best").alias("_best")), F.col(channel).eqNullSafe(F.col("_c"))).drop("_c")
    enough = F.col("stars") / F.nullif("_best", F.lit(0.0)) >= POLICY["clean_sources"]
    ok = F.coalesce(sound & F.col("registration_ok") & (clean("extinction") < POLICY["clean_extinction"]) & enough & clean("sky").isNotNull(), F.lit(False))
    slope = F.when(ok & (F.col("transparency") > 0), clean("gradient") / F.col("transparency"))
    middle = lambda c: F.when(F.count(c) >= POLICY["clean_frames"], F.percentile(c, F.lit(0.5)))
    of = rows.groupBy(F.col(channel).alias("_c")).agg(F.count_if(ok).alias("clean_frames"), middle(F.when(ok, clean("sky"))).alias("sky_clean"), middle(slope).alias("_gradient"))
    joined = best.join(of, F.col(channel).eqNullSafe(F.col("_c")))
    return joined.select(channel, "frames", "clean_frames", "sources_best", "fwhm_best", "sky_clean", F.when(F.col("_gradient") > 0, F.col("_gradient")).alias("gradient_clean"))


def _flag(code: str, when: Column, exclude: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.when(exclude, "EXCLUDE").otherwise("ATTENTION").alias("severity")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def flagged(df: DataFrame, channel: str = "channel") -> DataFrame:
    """df, joined with its channel, with source_ratio, sky_ratio, fwhm_ratio, flags (code, severity), notes and decision."""
    p, c = POLICY, F.col
    of = channels(df, channel)
    rows = df.join(of.withColumnRenamed(channel, "_c"), c(channel).eqNullSafe(c("_c"))).drop("_c")
    rows = rows.withColumns({"source_ratio": _ratio(c("stars").cast("double"), c("sources_best")), "sky_ratio": _ratio(clean("sky"), c("sky_clean")), "fwhm_ratio": _ratio(clean("fwhm"), c("fwhm_best"))})
    gradient = F.when(c("transparency") > 0, _ratio(clean("gradient") / c("transparency"), c("gradient_clean")))
    yes, no = F.lit(True), F.lit(False)
    own = F.array_compact(F.array(
        _flag("BLINK_SKY_BRIGHT", c("sky_ratio") >= p["sky"], F.coalesce(c("source_ratio") <= p["sky_sources"], no)),
        _flag("BLINK_SOURCES_LOW", c("source_ratio") <= p["sources"], c("source_ratio") <= p["sources_few"]),
        _flag("BLINK_EXTINCTION", clean("extinction") >= p["extinction"], clean("extinction") >= p["extinction_strong"]),
        _flag("BLINK_BACKGROUND_SHAPE", clean("background_shape") >= p["shape"], no),
        _flag("BLINK_GRADIENT_AMPLITUDE", gradient >= p["gradient"], gradient >= p["gradient_strong"]),
        _flag("BLINK_FWHM_WIDE", c("fwhm_ratio") >= p["fwhm"], c("fwhm_ratio") >= p["fwhm_strong"]),
        _flag("BLINK_STARS_ELONGATED", clean("ellipticity") >= p["elongated"], no),
        _flag("BLINK_UNREGISTRABLE", ~F.coalesce(c("registration_ok"), no), yes),
        _flag("BLINK_FEW_STARS", c("stars") < p["few_stars"], yes),
    ))
    rows = rows.withColumn("_own", own)
    told = F.create_map(*[x for k, (code, severity) in GATE_FLAGS.items() for x in (F.lit(k), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))])
    mapped = F.array_compact(F.transform("gate_codes", lambda g: F.element_at(told, g)))
    fresh = F.filter(mapped, lambda f: ~F.exists("_own", lambda o: o["code"] == f["code"]) & ~((f["code"] == "BLINK_REGISTRATION_WEAK") & ~F.coalesce(c("registration_ok"), no)))
    rows = rows.withColumn("_told", F.coalesce(fresh, F.array().cast("array<struct<code:string,severity:string>>")))
    # Of several findings that give one flag, the first counts.
    first = F.filter("_told", lambda f, i: F.array_position(F.transform("_told", lambda t: t["code"]), f["code"]) == i + 1)
    rows = rows.withColumn("flags", F.concat("_own", first)).withColumn("notes", F.coalesce(F.array_distinct(F.filter("gate_codes", lambda g: g.isin(*NOTES))), F.array().cast("array<string>")))
    return rows.withColumn("decision", F.when(F.exists("flags", lambda f: f["severity"] == "EXCLUDE"), "DROP").otherwise("KEEP")).drop("_own", "_told")


def night_summaries(frames: DataFrame, channel: str = "channel", night: str = "night") -> DataFrame:
    """(channel, night, frames, medians, exclude, attention, drop_night) of flagged() frames; a missing night is UNKNOWN."""
    has = lambda s: F.exists("flags", lambda f: f["severity"] == s)
    median = lambda c: F.percentile(clean(c), F.lit(0.5))
    out = frames.groupBy(channel, F.coalesce(F.col(night).cast("string"), F.lit("UNKNOWN")).alias(night)).agg(
        F.count("*").alias("frames_of_night"), median("sky").alias("median_sky"), median("sky_ratio").alias("sky_ratio"), median("source_ratio").alias("source_ratio"), median("extinction").alias("median_extinction"),
        F.count_if(has("EXCLUDE")).alias("exclude"), F.count_if(~has("EXCLUDE") & has("ATTENTION")).alias("attention"),
    )
    return out.withColumn("drop_night", F.col("exclude") == F.col("frames_of_night"))
