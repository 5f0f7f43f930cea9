"""Measures of sources, backgrounds and finished stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import cut, held
from .stats import MADN, clean, exact_quantile, over, with_median_mad


def flatness(tiles: DataFrame, keys: list[str], background: str, dark: float = 0.70) -> DataFrame:
    """(keys, n, flatness): p95 - p05 of the darkest share of the tile backgrounds."""
    v = clean(background)
    rows = tiles.withColumn("_c", F.percentile(v, F.lit(dark)).over(over(keys))).where(v <= F.col("_c"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.percentile(v, F.lit(0.95)) - F.percentile(v, F.lit(0.05))).alias("flatness"))


def robust_ratio(df: DataFrame, keys: list[str], ratio: str, passes: int = 3, clip: float = 4.0, least: int = 16) -> DataFrame:
    """(keys, n, ratio): median of ratios from half to twice the first median, clipped in passes; null with fewer than `least`."""
    w = over(keys)
    rows = df.where(clean(ratio) > 0).withColumn("_v", clean(ratio))
    middle = F.percentile("_v", F.lit(0.5)).over(w)
    rows = rows.withColumn("_m", middle).where("_v between 0.5 * _m and 2 * _m")
    for _ in range(passes):
        rows = rows.withColumn("_m", middle)
        rows = rows.withColumn("_s", MADN * F.percentile(F.abs(F.col("_v") - F.col("_m")), F.lit(0.5)).over(w))
        rows = rows.where((F.col("_s") == 0) | (F.abs(F.col("_v") - F.col("_m")) <= clip * F.col("_s")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.percentile("_v", F.lit(0.5))).alias("ratio"))


def half_flux_radius(samples: DataFrame, keys: list[str], radius: str, flux: str, share: float = 0.5) -> DataFrame:
    """(keys, total, radius): where the cumulative flux first reaches the share of the total, interpolated."""
    by_radius = samples.where(clean(flux).isNotNull()).groupBy(*keys, radius).agg(F.sum(clean(flux)).alias("_f"))
    run = Window.partitionBy(*keys).orderBy(radius).rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*keys).orderBy(radius)
    rows = by_radius.withColumns({"_c": F.sum("_f").over(run), "_t": F.sum("_f").over(over(keys)), "_p": F.coalesce(F.lag(radius).over(order), F.lit(0.0))})
    goal = share * F.col("_t")
    hit = rows.where((F.col("_t") > 0) & (F.col("_c") >= goal))
    inside = F.col("_p") + (F.col(radius) - F.col("_p")) * F.when(F.col("_f") != 0, (goal - (F.col("_c") - F.col("_f"))) / F.col("_f")).otherwise(1.0)
    return hit.groupBy(*keys).agg(F.max("_t").alias("total"), F.min_by(inside, radius).alias("radius"))


def dither_phases(df: DataFrame, keys: list[str], dx: str, dy: str, steps: int = 4) -> DataFrame:
    """(keys, frames, phases): distinct sub-pixel phases of the shifts."""
    phase = lambda c: F.pmod(F.floor((F.col(c) - F.floor(F.col(c))) * steps + 0.5), F.lit(steps))
    return df.groupBy(*keys).agg(F.count("*").alias("frames"), F.count_distinct(F.struct(phase(dx), phase(dy))).alias("phases"))


def tolerance_gate(df: DataFrame, keys: list[str], ours: str, theirs: str, sigma: Column, bulk: float = 0.1, outlier: float = 1.0) -> DataFrame:
    """(keys, n, equal, bulk_share, outlier_share) of two versions of one stack, in units of its noise."""
    d = F.abs(clean(ours) - clean(theirs))
    both = d.isNotNull()
    n = F.count_if(both)
    return df.groupBy(*keys).agg(n.alias("n"), F.count_if(d == 0).alias("equal"), F.try_divide(F.count_if(d <= bulk * sigma), n).alias("bulk_share"), F.try_divide(F.count_if(d > outlier * sigma), n).alias("outlier_share"))


def airmass_envelope(df: DataFrame, keys: list[str], x: str, y: str, order: str, slopes: tuple[float, float] = (-0.05, 3.0)) -> DataFrame:
    """df with excess over the clear-sky line of its group.

    With fewer than 4 points of valid airmass (0.9 to 10) it is null; with a span below 0.15, y less
    the 5th percentile; else the residual of a clamped Theil-Sen slope, less its 5th percentile.
    """
    from .stats import theil_sen

    ok = clean(x).between(0.9, 10) & clean(y).isNotNull()
    rows = df.withColumns({"_x": F.when(ok, clean(x)), "_y": F.when(ok, clean(y))})
    w = over(keys)
    rows = rows.withColumns({"_n": F.count("_x").over(w), "_span": F.max("_x").over(w) - F.min("_x").over(w)})
    fit = theil_sen(rows.where("_x is not null"), keys, "_x", "_y", order).select(*keys, F.greatest(F.least("slope", F.lit(slopes[1])), F.lit(slopes[0])).alias("_slope"))
    rows = rows.join(fit, keys, "left").withColumn("_e", F.col("_y") - F.when(F.col("_span") < 0.15, 0.0).otherwise(F.coalesce("_slope", F.lit(0.0))) * F.col("_x"))
    excess = F.col("_e") - F.percentile("_e", F.lit(0.05)).over(w)
    return rows.withColumn("excess", F.when(F.col("_n") >= 4, excess)).drop("_x", "_y", "_n", "_span", "_slope", "_e")


def sensor_fixed(matches: DataFrame, keys: list[str], x1: str, y1: str, x2: str, y2: str, most: float = 0.5) -> DataFrame:
    """(keys, n, fixed_share, fixed): matches that stay on one sensor pixel in both frames are defects, not stars."""
    same = (F.round(x1) == F.round(x2)) & (F.round(y1) == F.round(y2))
    out = matches.groupBy(*keys).agg(F.count("*").alias("n"), (F.count_if(same) / F.count("*")).alias("fixed_share"))
    return out.withColumn("fixed", F.col("fixed_share") > most)


def stamps(points: DataFrame, samples: DataFrame, keys: list[str], pid: str, x: str, y: str, half: int, tile: int = 64) -> DataFrame:
    """(keys, pid, dx, dy, value): the samples of a small window about each point; points meet tiles of samples, at most four each."""
    px, py = F.floor(F.col(x) + 0.5).cast("int"), F.floor(F.col(y) + 0.5).cast("int")
    reach = lambda c: F.array_distinct(F.array(F.floor((c - half) / tile), F.floor((c + half) / tile)))
    p = points.select(*keys, pid, px.alias("_px"), py.alias("_py")).withColumn("_tx", F.explode(reach(F.col("_px")))).withColumn("_ty", F.explode(reach(F.col("_py"))))
    s = samples.withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    met = p.join(s, [*keys, "_tx", "_ty"]).withColumns({"dx": F.col("x") - F.col("_px"), "dy": F.col("y") - F.col("_py")})
    return met.where((F.abs("dx") <= half) & (F.abs("dy") <= half)).select(*keys, pid, "dx", "dy", "value")


def triangles(points: DataFrame, keys: list[str], pid: str, x: str, y: str, flux: str, top: int = 12) -> DataFrame:
    """(keys, a, b, c, r1, r2): side ratios (largest over middle and over smallest side) of the triangles of the brightest points."""
    w = Window.partitionBy(*keys).orderBy(F.col(flux).desc(), pid)
    p = points.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).select(*keys, F.col(pid).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    a, b, c = (p.select(*keys, *[F.col(n).alias(f"{n}{i}") for n in ("id", "x", "y")]) for i in "abc")
    met = a.join(b, keys).where("ida < idb").join(c, keys).where("idb < idc")  # at most top choose 3 a key
    side = lambda i, j: F.sqrt(F.pow(F.col(f"x{i}") - F.col(f"x{j}"), 2) + F.pow(F.col(f"y{i}") - F.col(f"y{j}"), 2))
    met = met.withColumn("_s", F.array_sort(F.array(side("a", "b"), side("b", "c"), side("a", "c"))))
    s = lambda i: F.get("_s", F.lit(i))
    return met.where(s(0) > 0).select(*keys, F.col("ida").alias("a"), F.col("idb").alias("b"), F.col("idc").alias("c"), F.try_divide(s(2), s(1)).alias("r1"), F.try_divide(s(2), s(0)).alias("r2"))


def triangle_votes(left: DataFrame, right: DataFrame, keys: list[str], radius: float = 0.1) -> DataFrame:
    """(keys, left_id, right_id, votes): points paired by triangles whose side ratios lie within the radius."""
    from .joins import radius_pairs

    name = lambda df: df.withColumn("t", F.concat_ws("-", "a", "b", "c"))
    one, two = name(left), name(right)
    met = radius_pairs(one, two, keys, "t", "t", "r1", "r2", radius)
    l = one.select(*keys, F.col("t").alias("left_id"), F.array("a", "b", "c").alias("la"))  # noqa: E741
    m = two.select(*keys, F.col("t").alias("right_id"), F.array("a", "b", "c").alias("ra"))
    votes = met.join(l, [*keys, "left_id"]).join(m, [*keys, "right_id"]).select(*keys, F.explode("la").alias("p"), "ra").select(*keys, F.col("p").alias("left_id"), F.explode("ra").alias("right_id"))
    return votes.groupBy(*keys, "left_id", "right_id").agg(F.count("*").alias("votes"))


def background_shape(cells: DataFrame, keys: list[str], frame: str, row: str, col: str, value: str, core: tuple[int, int] = (4, 11)) -> DataFrame:
    """(keys, frame, shape): p95 - p05, outside the core, of what a frame's grid has beyond its group's median grid."""
    v = clean(value)
    rows = cells.where(v.isNotNull()).withColumn("_v", v - F.percentile(v, F.lit(0.5)).over(over([*keys, frame])))
    rows = rows.withColumn("_d", F.col("_v") - F.percentile("_v", F.lit(0.5)).over(over([*keys, row, col])))
    inside = F.col(row).between(*core) & F.col(col).between(*core)
    return rows.where(~inside).groupBy(*keys, frame).agg((F.percentile("_d", F.lit(0.95)) - F.percentile("_d", F.lit(0.05))).alias("shape"))


def neighbour_noise(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n, noise): MADN of differences to the neighbour, over the square root of two; null below 64 differences."""
    step = clean(value) - F.lag(clean(value)).over(Window.partitionBy(*keys).orderBy(*order))
    rows = with_median_mad(df.withColumn("_d", step), keys, "_d")
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), F.when(F.max("n") >= 64, MADN * F.max("mad") / F.sqrt(F.lit(2.0))).alias("noise"))


def histogram_lines(df: DataFrame, keys: list[str], x: str, width: float, sigmas: float = 5.0) -> DataFrame:
    """df without the bins that hold far more points than the bins' mean (lines of false sources)."""
    binned = df.withColumn("_bin", F.floor(F.col(x) / width))
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    w = over(keys)
    counts = counts.withColumn("_m", F.avg("_c").over(w))
    bad = counts.where(F.col("_c") > F.col("_m") + sigmas * F.sqrt("_m")).select(*keys, "_bin")
    return binned.join(bad, [*keys, "_bin"], "left_anti").drop("_bin")


def thinned(df: DataFrame, keys: list[str], x: str, y: str, cell: float, flux: str, tie: str, most: int) -> DataFrame:
    """At most `most` rows a key, spread over the field: first the brightest of each cell, then the second, and so on."""
    cells = df.withColumns({"_cx": F.floor(F.col(x) / cell), "_cy": F.floor(F.col(y) / cell)})
    turn = F.row_number().over(Window.partitionBy(*keys, "_cx", "_cy").orderBy(F.col(flux).desc(), tie))
    rows = cells.withColumn("_turn", turn)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_turn", F.col(flux).desc(), tie))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_cx", "_cy", "_turn", "_place")


#: Ratios of all frames that throughput() takes medians of at once; of more, they are counted in bins.
FEW = 1 << 20


def throughput(frames: DataFrame, pairs: DataFrame, keys: list[str], frame: str, least: int = 16, clip: float = 4.0) -> DataFrame:
    """(keys, frame, reference, scale, sigma, stars, status, reason): each frame's flux scale to its group's reference.

    Frames have (keys, frame, reference, exposure); pairs have (keys, frame, flux, reference_flux), one row for each star matched
    with the reference.  Ratios, corrected for the exposures, from half to twice their median are clipped in three passes at `clip`
    scaled deviations, as long as `least` remain.  A frame that can't be scaled keeps its row with a reason, and the
    reference itself has scale 1.  Repeated frames count once, with their least reference and exposure.
    """
    # Status and reasons are fixed values.
    known = frames.groupBy(*keys, frame).agg(F.min("reference").alias("reference"), F.min(clean("exposure")).alias("_e"))
    reference = known.select(*keys, F.col(frame).alias("reference"), F.col("_e").alias("_re"))
    known = known.join(reference, [*keys, "reference"], "left")
    own = {k: f"_k{i}" for i, k in enumerate([*keys, frame])}
    at = list(own.values())

    def beside(rows: DataFrame, other: DataFrame) -> DataFrame:
        """Rows with the values of their frame, which stay where they are: a frame may have most of all stars."""
        return rows.join(other if few else held(other), at)

    def half(rows: DataFrame, value: str, name: str) -> DataFrame:
        return rows.groupBy(*at).agg(F.percentile(value, F.lit(0.5)).alias(name)) if few else exact_quantile(rows, at, value).withColumnRenamed("quantile", name)

    exposed = (F.col("_e") > 0) & (F.col("_re") > 0)
    usable = pairs.where((clean("flux") > 0) & (clean("reference_flux") > 0)).select(*keys, frame, "flux", "reference_flux")
    rows = cut(usable.join(known.where(exposed), [*own]).select(*[F.col(k).alias(n) for k, n in own.items()], (F.col("reference_flux") / F.col("flux") * F.col("_e") / F.col("_re")).alias("_v")))
    few = rows.count() <= FEW
    enough = rows.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    rows = cut(beside(rows, half(beside(rows, enough), "_v", "_m")).where("_v between 0.5 * _m and 2 * _m").select(*at, "_v"))
    for _ in range(3):
        rows = beside(rows, half(rows, "_v", "_m")).withColumn("_d", F.abs(F.col("_v") - F.col("_m")))
        rows = cut(beside(rows, half(rows, "_d", "_s")).withColumn("_s", MADN * F.col("_s")).withColumn("_k", F.col("_d") <= clip * F.col("_s")))
        rows = beside(rows, rows.groupBy(*at).agg(F.count_if("_k").alias("_left")))
        rows = cut(rows.where(F.col("_k") | (F.col("_s") <= 2.220446049250313e-16) | (F.col("_left") < least)).select(*at, "_v"))
    rows = beside(rows, half(rows, "_v", "_scale")).withColumn("_d", F.abs(F.col("_v") - F.col("_scale")))
    spread = half(rows, "_d", "_sigma").withColumn("_sigma", MADN * F.col("_sigma"))
    scales = rows.groupBy(*at).agg(F.max("_scale").alias("_scale"), F.count("*").alias("_stars"))
    scales = scales.join(spread, at).withColumnsRenamed({n: k for k, n in own.items()})
    counts = usable.groupBy(*keys, frame).agg(F.count("*").alias("_pairs"))
    out = known.join(counts, [*keys, frame], "left").join(scales, [*keys, frame], "left")
    itself = F.col(frame) == F.col("reference")
    fit = exposed & (F.col("_stars") >= least)
    reason = (
        F.when(itself | fit, F.lit(None).cast("string"))
        .when(F.col("reference").isNull(), "no reference")
        .when(~F.coalesce(exposed, F.lit(False)), "positive source/reference exposure is required for stellar scale")
        .when(F.coalesce("_pairs", F.lit(0)) < least, "too few positive stellar flux ratios")
        .otherwise("too few bounded stellar flux ratios")
    )
    status = F.when(itself, "REFERENCE_IDENTITY").when(fit, "STELLAR_SCALE_ACCEPTED").otherwise("STELLAR_SCALE_UNAVAILABLE")
    pick = lambda c, one: F.when(itself, F.lit(one)).when(fit, F.col(c))
    return out.select(*keys, frame, "reference", pick("_scale", 1.0).alias("scale"), pick("_sigma", 0.0).alias("sigma"), pick("_stars", None).alias("stars"), status.alias("status"), reason.alias("reason"))


def frame_quality(stars: DataFrame, keys: list[str], frame: str, fwhm: str, peak: str, flux: str) -> DataFrame:
    """(keys, frame, stars, fwhm, quality, native, weight) from star rows; `weight` is native over the median of the positive ones of its group.

    quality = least(stars, 500) / greatest(fwhm^2, 1/4); native = peaks * fwhm^2 / (fluxes * stars), 0 without flux.
    """
    sums = stars.groupBy(*keys, frame).agg(F.count("*").alias("stars"), F.percentile(clean(fwhm), F.lit(0.5)).alias("fwhm"), F.sum(clean(peak)).alias("_p"), F.sum(clean(flux)).alias("_f"))
    area = F.col("fwhm") * F.col("fwhm")
    native = F.when(F.col("_f") > 0, F.col("_p") * area / (F.col("_f") * F.col("stars"))).otherwise(0.0)
    rows = sums.withColumns({"quality": F.least("stars", F.lit(500)) / F.greatest(area, F.lit(0.25)), "native": native})
    middle = F.percentile(F.when(F.col("native") > 0, F.col("native")), F.lit(0.5)).over(over(keys))
    return rows.withColumn("weight", F.coalesce(F.col("native") / middle, F.lit(0.0))).drop("_p", "_f")
