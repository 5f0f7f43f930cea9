"""A frame against its reference and its group: footprints, completeness, the reference for normalisation, channels to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import clean, over

# Cells of a side, coarse cells, stars a cell needs, cells a percentile needs.
CELLS, CELL_STARS, LEAST_CELLS = 16, 3, 16
# Share of a group's best frames that may be its normalisation reference, and the weight of the sky.
BEST_SHARE, SKY_WEIGHT = 0.75, 0.02


def in_footprint(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a reference point comes from inside the frame, by the inverse of the similarity a, b, tx, ty; null model: false."""
    a, b, dx, dy = F.col("a"), F.col("b"), x - F.col("tx"), y - F.col("ty")
    n = a * a + b * b
    u, v = F.try_divide(a * dx + b * dy, n), F.try_divide(a * dy - b * dx, n)
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def cell_of(x: Column, y: Column, width: Column, height: Column, cells: int = CELLS) -> Column:
    """Number of the grid cell of a point, row by row; null outside."""
    i, j = F.floor(F.try_divide(x, width) * cells), F.floor(F.try_divide(y, height) * cells)
    return F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), (F.least(j, F.lit(cells - 1)) * cells + F.least(i, F.lit(cells - 1))).cast("int"))


def completeness(expected: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, matched, completeness, transparency, spread, spatial_p90) of frames against their reference.

    `expected`: (keys, x, y, width, height, a, b, tx, ty), a row each reference star; those outside the
    frame's footprint aren't missed.  `matches`: (keys, cell, flux, reference_flux), a row each inlier, the
    fluxes at one exposure.  Transparency is the median flux ratio, spread the median of |magnitude
    residuals|; spatial_p90 the 90th percentile of |cell medians| where LEAST_CELLS cells hold CELL_STARS.
    """
    seen = expected.where(in_footprint(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    wanted = seen.groupBy(*keys).agg(F.count("*").alias("expected"))
    inside = matches.where("cell is not null")
    ratio = F.when((clean("flux") > 0) & (clean("reference_flux") > 0), F.try_divide(clean("flux"), clean("reference_flux")))
    rows = inside.withColumn("_r", ratio).withColumn("_g", F.percentile("_r", F.lit(0.5)).over(over(keys)))
    rows = rows.withColumn("_e", -2.5 * F.log10(F.try_divide("_r", "_g")))
    total = rows.groupBy(*keys).agg(F.count("*").alias("matched"), F.max("_g").alias("transparency"), F.percentile(F.abs("_e"), F.lit(0.5)).alias("spread"))
    cell = rows.where("_e is not null").groupBy(*keys, "cell").agg(F.count("*").alias("_n"), F.percentile("_e", F.lit(0.5)).alias("_m")).where(F.col("_n") >= CELL_STARS)
    patch = cell.groupBy(*keys).agg(F.when(F.count("*") >= LEAST_CELLS, F.percentile(F.abs("_m"), F.lit(0.9))).alias("spatial_p90"))
    frames = expected.select(*keys).distinct().join(wanted, keys, "left").join(total, keys, "left").join(patch, keys, "left").na.fill(0, ["expected", "matched"])
    return frames.select(*keys, "expected", "matched", F.try_divide("matched", "expected").alias("completeness"), "transparency", "spread", "spatial_p90")


def normalisation_reference(frames: DataFrame, keys: list[str], key: str, quality: str, span: str, sky: str, allowed: Column | None = None) -> DataFrame:
    """(keys, reference, score, considered): the frame of least span + SKY_WEIGHT sky among the best BEST_SHARE by quality.

    Only allowed frames, or all of a group without any; an unknown span comes last; ties to the smaller key.
    """
    ok = F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)
    rows = frames.withColumn("_ok", ok).withColumn("_any", F.max("_ok").over(over(keys))).where("_ok or not _any")
    order = Window.partitionBy(*keys).orderBy(clean(quality).desc_nulls_last(), key)
    rows = rows.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(over(keys))}).where(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.round(BEST_SHARE * F.col("_n"), 9))))
    score = F.coalesce(clean(span), F.lit(float("inf"))) + SKY_WEIGHT * F.coalesce(clean(sky), F.lit(0.0))
    best = rows.groupBy(*keys).agg(F.min(F.struct(score.alias("s"), F.col(key).alias("k"))).alias("b"), F.count("*").alias("considered"))
    return best.select(*keys, F.col("b.k").alias("reference"), F.col("b.s").alias("score"), "considered")


def suspect_channels(channels: DataFrame, blocks: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, codes, kept, unmeasured, guarded): channels that a user should look at.

    `channels`: (keys, frames, sky_clean).  `blocks`: (keys, outcome) of suspect blocks, where any outcome
    but REMOVED and KEPT, null included, is unmeasured.  `decisions`: (keys, reasons array of codes).
    """
    outcome = F.coalesce("outcome", F.lit("NOT_MEASURED"))
    b = blocks.groupBy(*keys).agg(F.count_if(outcome == "KEPT").alias("kept"), F.count_if(~outcome.isin("KEPT", "REMOVED")).alias("unmeasured"))
    d = decisions.groupBy(*keys).agg(F.count_if(F.array_contains("reasons", "SEL_SOFT_GUARD_KEPT")).alias("guarded"))
    rows = channels.join(b, keys, "left").join(d, keys, "left").na.fill(0, ["kept", "unmeasured", "guarded"])
    codes = {"SUSPECT_BLOCK_KEPT": F.col("kept") > 0, "SUSPECT_BLOCK_UNMEASURED": F.col("unmeasured") > 0, "NO_SKY_BASELINE": F.col("sky_clean").isNull() & (F.col("frames") > 3), "SOFT_GUARD_KEPT": F.col("guarded") > 0}
    rows = rows.withColumn("codes", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes.items()])))
    return rows.where(F.size("codes") > 0).select(*keys, "codes", "kept", "unmeasured", "guarded")


def overridden(frames: DataFrame, overrides: DataFrame, digest: str, columns: list[str]) -> DataFrame:
    """df with the overrides' non-null values of `columns` where the digest names it, and `override_error`.

    A digest that several frames or several overrides share is AMBIGUOUS and changes nothing.
    """
    o = overrides.groupBy(digest).agg(F.count("*").alias("_on"), *[F.any_value(c).alias(f"_o_{c}") for c in columns])
    rows = frames.withColumn("_fn", F.count("*").over(Window.partitionBy(digest))).join(o, digest, "left")
    sure = (F.col("_on") == 1) & (F.col("_fn") == 1)
    values = {c: F.when(sure, F.coalesce(F.col(f"_o_{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}
    rows = rows.withColumns(values | {"override_error": F.when(F.col("_on").isNotNull() & ~sure, "AMBIGUOUS")})
    return rows.select(*frames.columns, "override_error")


def joined_once(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left joined to right one to one, with `join_error`: DUPLICATE where either side repeats the key, MISSING where right lacks it.

    A repeated or missing key keeps its left rows, without right values.
    """
    once = right.withColumn("_rn", F.count("*").over(Window.partitionBy(*on)))
    number = once.select(*on, "_rn").distinct()
    rows = left.withColumn("_ln", F.count("*").over(Window.partitionBy(*on))).join(number, on, "left").join(once.where("_rn = 1").drop("_rn"), on, "left")
    error = F.when((F.col("_ln") > 1) | (F.col("_rn") > 1), "DUPLICATE").when(F.col("_rn").isNull(), "MISSING")
    extra = [c for c in right.columns if c not in on]
    return rows.select(*left.columns, *[F.when(error.isNull(), F.col(c)).alias(c) for c in extra], error.alias("join_error"))


def ordered_unique(codes: Column) -> Column:
    """Codes in the order of their first place, each once, nulls left out."""
    return F.array_distinct(F.array_compact(codes))


def trail_extent(samples: DataFrame, keys: list[str], along: str, value: str, sigma: str, seed: str, bins: int = 32, threshold: float = 0.12) -> DataFrame:
    """(keys, start, stop): how far a trail reaches from its seed while the running mean of `bins` samples stays over the threshold.

    Gaps of up to two windows are bridged.  If the sample nearest to the seed is off, the nearest sample that
    is on counts, unless it lies over two windows away; a trail without one, or with fewer
    samples than `bins`, has no row.  Samples beyond the ends count as zero in the mean.
    """
    w = Window.partitionBy(*keys).orderBy(along)
    rows = samples.where(clean(value).isNotNull()).withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(over(keys))}).where(F.col("_n") >= bins)
    mean = F.sum(clean(value)).over(w.rowsBetween(-(bins // 2), bins - bins // 2 - 1)) / bins
    rows = rows.withColumn("_on", mean > threshold * F.col(sigma))
    # A seed's own place is the nearest sample's, the earlier of two.
    gap = F.abs(F.col(along) - F.col(seed))
    rows = rows.withColumn("_c", F.min(F.struct(gap.alias("g"), F.col("_i").alias("i"))).over(over(keys))["i"])
    on = rows.where("_on")
    on = on.withColumn("_new", F.when(F.col("_i") - F.lag("_i").over(w) - 1 > 2 * bins, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    near = F.struct(F.abs(F.col("_i") - F.col("_c")).alias("d"), F.col("_i").alias("i"), F.col("_run").alias("run"), gap.alias("g"))
    on = on.withColumn("_b", F.min(near).over(over(keys))).where((F.col("_run") == F.col("_b.run")) & ((F.col("_b.d") == 0) | (F.col("_b.g") <= 2 * bins)))
    return on.groupBy(*keys).agg(F.min(along).alias("start"), F.max(along).alias("stop"))

