"""Flags, scores and decisions: rules as expressions, blocks, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import MADN, best_high, best_low, clean, over

def channel_statistics(df: DataFrame, keys: list[str], clean_when: Column, sources: str, fwhm: str, sky: str) -> DataFrame:
    """(keys, frames, clean_frames, sources_best, fwhm_best, sky_clean) of a channel."""
    s, f, b = clean(sources), clean(fwhm), clean(sky)
    ok = F.coalesce(clean_when, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count("*").alias("frames"),
        F.count_if(ok).alias("clean_frames"),
        best_high(s).alias("sources_best"),
        best_low(f).alias("fwhm_best"),
        F.when(F.count(F.when(ok, b)) >= 3, F.percentile(F.when(ok, b), F.lit(0.5))).alias("sky_clean"),
    )


def absolute_flags(sources: Column, sources_best: Column, fwhm: Column, fwhm_best: Column, sky: Column, sky_clean: Column, extinction: Column, ellipticity: Column, stars: Column) -> Column:
    """Sorted flag names of a frame against its channel; thresholds are fixed values of the rule set."""
    source_ratio, sky_ratio, fwhm_ratio = sources / F.nullif(sources_best, F.lit(0.0)), sky / F.nullif(sky_clean, F.lit(0.0)), fwhm / F.nullif(fwhm_best, F.lit(0.0))
    items = {
        "SKY_BRIGHT": sky_ratio >= 1.6,
        "SKY_BRIGHT_FEW_SOURCES": (sky_ratio >= 1.6) & (source_ratio <= 0.60),
        "SOURCES_LOW": (source_ratio <= 0.60) & (source_ratio > 0.45),
        "SOURCES_VERY_LOW": source_ratio <= 0.45,
        "EXTINCTION": (extinction >= 0.50) & (extinction < 1.00),
        "EXTINCTION_STRONG": extinction >= 1.00,
        "FWHM_LARGE": (fwhm_ratio >= 1.30) & (fwhm_ratio < 1.60),
        "FWHM_VERY_LARGE": fwhm_ratio >= 1.60,
        "ELONGATED": ellipticity >= 0.30,
        "FEW_STARS": stars < 20,
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in items.items()])))


EXCLUDING = ("SKY_BRIGHT_FEW_SOURCES", "SOURCES_VERY_LOW", "EXTINCTION_STRONG", "FWHM_VERY_LARGE", "FEW_STARS")


def default_decision(flags: Column) -> Column:
    return F.when(F.exists(flags, lambda f: f.isin(*EXCLUDING)), "DROP").otherwise("KEEP")


def frame_score(transparency: Column, sky_mad: Column, fwhm_best: Column, fwhm: Column, ellipticity: Column, stars: Column, richest: Column) -> Column:
    """Value of a frame: signal over sky noise, sharpness, roundness and richness."""
    signal = transparency / F.nullif(MADN * sky_mad, F.lit(0.0))
    return signal * signal * F.pow(fwhm_best / F.nullif(fwhm, F.lit(0.0)), 2) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ellipticity)) * F.least(F.lit(1.0), stars / F.nullif(richest, F.lit(0.0)))


def suspect_blocks(df: DataFrame, group: list[str], block: str, value: str, marked: Column, least_value: float = 0.36, most: int = 4) -> DataFrame:
    """(group, block, frames, median_value, marked_share, suspect): at most `most` a group, lowest value first."""
    rows = df.groupBy(*group, block).agg(F.count("*").alias("frames"), F.percentile(clean(value), F.lit(0.5)).alias("median_value"), (F.count_if(marked) / F.count("*")).alias("marked_share"))
    bad = F.coalesce(F.col("median_value") < least_value, F.lit(False)) | (F.col("marked_share") >= 0.5)
    rank = F.row_number().over(over(group).orderBy(F.when(bad, 0).otherwise(1), F.col("median_value").asc_nulls_first(), block))
    return rows.withColumn("suspect", bad & (rank <= most))


def harmful(df: DataFrame, group: list[str], delta: str, low: str, tiles: str, threshold: float = 0.005) -> DataFrame:
    """df with `harmful`: at least 16 tiles, a low bound beyond the threshold, and a delta above median + 3 MADN of its group."""
    w = over(group)
    rows = df.withColumn("_m", F.percentile(clean(delta), F.lit(0.5)).over(w))
    rows = rows.withColumn("_s", MADN * F.percentile(F.abs(clean(delta) - F.col("_m")), F.lit(0.5)).over(w))
    hit = (F.col(tiles) >= 16) & (F.col(low) > threshold) & (clean(delta) > F.col("_m") + 3 * F.col("_s"))
    return rows.withColumn("harmful", F.coalesce(hit, F.lit(False))).drop("_m", "_s")


def admitted(lights: DataFrame, key: str, route: str, decisions: DataFrame | None = None) -> DataFrame:
    """Lights that pass: `legacy` all but REJECT, `unattended` KEEP only, `explicit` those a decision keeps."""
    if route == "explicit":
        return lights.join(decisions.where("decision = 'KEEP'").select(key), key, "left_semi")
    if route == "unattended":
        return lights.where("decision = 'KEEP'")
    return lights.where(~F.col("decision").startswith("REJECT"))


def group_share_guard(df: DataFrame, group: list[str], dropped: Column, most: float = 0.5) -> DataFrame:
    """df with `held`: no drop holds in groups that would lose more than the share `most`."""
    share = F.count_if(dropped).over(over(group)) / F.count("*").over(over(group))
    return df.withColumn("held", dropped & (share <= most))


def relaxed_candidates(df: DataFrame, group: list[str], levels: list[Column]) -> DataFrame:
    """df's rows of the strictest level that has any in their group, with `level` (0 is strictest)."""
    level = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(levels)])
    rows = df.withColumn("level", level).where(F.col("level").isNotNull())
    return rows.withColumn("_m", F.min("level").over(Window.partitionBy(*group))).where("level = _m").drop("_m")
