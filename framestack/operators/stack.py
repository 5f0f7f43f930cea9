"""Reduction of stacks: many samples of one cell to one robust value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import cut, held
from .stats import MADN, clean, exact_quantile, over, with_median_mad

CLIP = 4.0
MIN_SAMPLES = 3
ABSOLUTE_FLOOR = 1e-7
EPS32 = 2.0**-23
HUBER = 1.345


def numeric_floor(med: Column) -> Column:
    return F.greatest(F.lit(ABSOLUTE_FLOOR), 16 * EPS32 * F.greatest(F.lit(1.0), F.abs(med)))


def with_decisions(df: DataFrame, keys: list[str], value: str, clip: float = CLIP, group_floor: float = ABSOLUTE_FLOOR) -> DataFrame:
    """df with n, med, mad, sigma and accepted: |x - med| <= clip sigma where the cell has MIN_SAMPLES, else every finite sample."""
    df = with_median_mad(df, keys, value)
    df = df.withColumn("sigma", F.greatest(MADN * F.col("mad"), F.lit(group_floor), numeric_floor(F.col("med"))))
    v = clean(value)
    return df.withColumn("accepted", v.isNotNull() & ((F.col("n") < MIN_SAMPLES) | (F.abs(v - F.col("med")) <= clip * F.col("sigma"))))


def weighted_mean(value: Column, weight: Column, where: Column) -> Column:
    total = F.sum(F.when(where, weight))
    return F.when(total > 0, F.sum(F.when(where, weight * value)) / total)


def clip_mean(df: DataFrame, keys: list[str], value: str, weight: str | None = None, clip: float = CLIP, group_floor: float = ABSOLUTE_FLOOR) -> DataFrame:
    """(keys, n, med, mad, mean, n_accepted, n_rejected): median and MAD clipping, then the weighted mean.

    One shuffle by the keys serves both windows and the aggregate.
    """
    rows = with_decisions(df, keys, value, clip, group_floor)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("med").alias("med"),
        F.max("mad").alias("mad"),
        weighted_mean(clean(value), w, F.col("accepted")).alias("mean"),
        F.count_if("accepted").alias("n_accepted"),
        (F.count(clean(value)) - F.count_if("accepted")).alias("n_rejected"),
    )


def clip_mean_large(df: DataFrame, keys: list[str], value: str, weight: str | None = None, clip: float = CLIP, group_floor: float = ABSOLUTE_FLOOR) -> DataFrame:
    """clip_mean() for few, large or very uneven groups: no task holds a group.

    Medians come from counts in bins (exact_quantile), the rest is sums that combine before the
    shuffle; the statistics of the groups are held() and joined back.
    """
    from .stats import exact_quantile

    v = clean(value)
    rows = df.withColumns({"_v": v, "_w": F.col(weight).cast("double") if weight else F.lit(1.0)})
    med = held(exact_quantile(rows, keys, "_v").withColumnRenamed("quantile", "med"))
    rows = rows.join(med, keys, "left").withColumn("_d", F.abs(F.col("_v") - F.col("med")))
    mad = exact_quantile(rows, keys, "_d").withColumnRenamed("quantile", "mad")
    n = rows.groupBy(*keys).agg(F.count("_v").alias("n"))
    rows = rows.join(held(n.join(mad, keys, "left")), keys, "left")
    sigma = F.greatest(MADN * F.col("mad"), F.lit(group_floor), numeric_floor(F.col("med")))
    ok = F.col("_v").isNotNull() & ((F.col("n") < MIN_SAMPLES) | (F.col("_d") <= clip * sigma))
    return rows.withColumn("_ok", ok).groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("med").alias("med"),
        F.max("mad").alias("mad"),
        weighted_mean(F.col("_v"), F.col("_w"), F.col("_ok")).alias("mean"),
        F.count_if("_ok").alias("n_accepted"),
        (F.count("_v") - F.count_if("_ok")).alias("n_rejected"),
    )


def cell_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, finite, invalid, low, high, mean): algebraic, so partial sums are merged."""
    v = clean(value)
    return df.groupBy(*keys).agg(F.count(v).alias("finite"), (F.count("*") - F.count(v)).alias("invalid"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))


def pooled_scale(df: DataFrame, row: str, column: str, frame: str, value: str, half: int = 12) -> DataFrame:
    """Samples with sigma of the second rejection rule.

    The MADs of a row's cells (those with MIN_SAMPLES) are pooled by a moving median over `half` cells
    on either side; a frame noisier than the mixture scales the pooled part; what a cell has beyond
    the pool is kept as excess.
    """
    cells = with_median_mad(df.where(clean(value).isNotNull()), [row, column], value)
    each = cells.groupBy(row, column).agg(F.max("n").alias("n"), F.max("mad").alias("mad"))
    near = Window.partitionBy(row).orderBy(column).rowsBetween(-half, half)
    pool = each.withColumn("pool", MADN * F.percentile(F.when(F.col("n") >= MIN_SAMPLES, F.col("mad")), F.lit(0.5)).over(near)).select(row, column, "pool")
    cells = cut(cells.join(pool, [row, column]))
    residual = F.abs(clean(value) - F.col("med"))
    usable = F.when(F.col("n") >= MIN_SAMPLES, residual)
    known = cells.select(frame, F.lit(0).alias("_all"), usable.alias("u"))
    frames = cells.select(frame).distinct().join(exact_quantile(known, [frame], "u").withColumnRenamed("quantile", "frame_mad"), frame, "left")
    mixture = exact_quantile(known, ["_all"], "u").agg(F.max("quantile").alias("mixture_mad"))  # one row
    factor = F.greatest(F.lit(1.0), F.col("frame_mad") / F.nullif(F.col("mixture_mad"), F.lit(0.0)))
    factors = frames.crossJoin(F.broadcast(mixture)).select(frame, F.coalesce(F.round(factor, 5), F.lit(1.0)).alias("factor"))
    pixel = MADN * F.col("mad")
    spread = F.sqrt(F.pow(F.col("factor") * F.col("pool"), 2) + F.greatest(pixel * pixel - F.col("pool") * F.col("pool"), F.lit(0.0)))
    return cells.join(factors, frame).withColumn("sigma", F.greatest(spread, numeric_floor(F.col("med"))))


def huber_mean(df: DataFrame, keys: list[str], value: str, weight: str | None = None, passes: int = 4) -> DataFrame:
    """(keys, mean): iteratively re-weighted from the clipped mean; all passes are windows over one shuffle."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = clean(value)
    rows = with_decisions(df, keys, value).where(v.isNotNull()).withColumn("w", w)
    part = over(keys)
    rows = rows.withColumn("mean", F.sum(F.when(F.col("accepted"), F.col("w") * v)).over(part) / F.nullif(F.sum(F.when(F.col("accepted"), F.col("w"))).over(part), F.lit(0.0)))
    for _ in range(passes):
        r = F.abs(v - F.col("mean")) / F.col("sigma")
        rows = rows.withColumn("u", F.col("w") * F.least(F.lit(1.0), HUBER / F.greatest(r, F.lit(HUBER))))
        rows = rows.withColumn("mean", F.sum(F.col("u") * v).over(part) / F.nullif(F.sum("u").over(part), F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.max("mean").alias("mean"))


def noise_weights(df: DataFrame, frame: str, order: list[str], value: str) -> DataFrame:
    """(frame, sigma, weight): from differences of neighbours, inverse variance, clipped to 1/16 and 16 medians, sum one."""
    step = clean(value) - F.lag(clean(value)).over(Window.partitionBy(frame).orderBy(*order))
    rows = df.withColumn("step", step)
    rows = with_median_mad(rows, [frame], "step")
    frames = rows.groupBy(frame).agg((MADN * F.max("mad") / F.sqrt(F.lit(2.0))).alias("sigma"))
    raw = frames.withColumn("raw", F.when(F.col("sigma") > 0, 1 / (F.col("sigma") * F.col("sigma"))).otherwise(1.0))
    middle = raw.agg(F.percentile("raw", F.lit(0.5)).alias("middle"))
    held = raw.crossJoin(F.broadcast(middle)).withColumn("raw", F.least(F.greatest("raw", F.col("middle") / 16), F.col("middle") * 16))
    total = held.agg(F.sum("raw").alias("total"))
    return held.crossJoin(F.broadcast(total)).select(frame, "sigma", (F.col("raw") / F.col("total")).alias("weight"))


def leave_one_out(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """df with mean_without: the weighted mean of the cell without this sample, from sums less its own."""
    w, v = F.col(weight).cast("double"), clean(value)
    part = over(keys)
    own = F.coalesce(F.when(v.isNotNull(), w), F.lit(0.0))
    s, t = F.sum(F.when(v.isNotNull(), w * v)).over(part), F.sum(own).over(part)
    return df.withColumn("mean_without", (s - F.coalesce(own * v, F.lit(0.0))) / F.nullif(F.when(t - own > 1e-9, t - own), F.lit(0.0)))


def leave_group_out(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """(keys, group, n, mean_without): the cell's mean without a whole group of samples; partial sums by group first."""
    v = clean(value)
    parts = df.groupBy(*keys, group).agg(F.count(v).alias("n"), F.sum(v).alias("s"))
    part = over(keys)
    rest = F.sum("n").over(part) - F.col("n")
    return parts.select(*keys, group, "n", F.when(rest > 0, (F.sum("s").over(part) - F.col("s")) / rest).alias("mean_without"))


def bootstrap_interval(df: DataFrame, unit: str, value: str, draws: int = 200, seed: int = 20260901, salt: int = 64) -> DataFrame:
    """(draws, low, high): 2.5 and 97.5 percentiles of the mean over resampled units.

    Poisson resampling: each unit has a repeatable count in each draw, so draws are plain sums that
    combine before the shuffle; no draw gathers its units.
    """
    units = df.groupBy(unit).agg(F.sum(clean(value)).alias("s"), F.count(clean(value)).alias("n"))
    drawn = units.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(unit), F.col("draw")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cdf, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 8):
        total += p
        cdf.append(total)
        p /= k
    times = sum((F.when(u > c, 1).otherwise(0) for c in cdf), F.lit(0))
    drawn = drawn.withColumn("times", times)
    means = drawn.groupBy("draw").agg((F.sum(F.col("times") * F.col("s")) / F.nullif(F.sum(F.col("times") * F.col("n")).cast("double"), F.lit(0.0))).alias("m"))
    return means.agg(F.count("*").alias("draws"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def expression(source: Column, subtract: list[tuple[float, Column]] = (), divisor: Column | None = None, floor: float = 1e-6, pattern: Column | None = None, scale: Column | float = 1.0, grid: Column | None = None, offset: Column | float = 0.0) -> Column:
    """(source - sum k sub) / divisor x pattern x scale + grid + offset; null where an input is, or the divisor is at most the floor."""
    out = clean(source)
    for k, sub in subtract:
        out = out - k * clean(sub)
    if divisor is not None:
        out = F.when(clean(divisor) > floor, out / divisor)
    if pattern is not None:
        out = out * pattern
    out = out * scale
    if grid is not None:
        out = out + grid
    return out + offset


def pattern_scale(scales: list[float], y: Column, x: Column) -> Column:
    """The scale of a 2 x 2 mosaic cell."""
    return F.element_at(F.array(*map(F.lit, scales)), ((y % 2) * 2 + x % 2 + 1).cast("int"))


def linear_fit(df: DataFrame, keys: list[str], value: str, weight: str | None = None, low: float = 5.0, high: float = 3.5, bisections: int = 10, rounds: int = 8) -> DataFrame:
    """(keys, n, mean, n_accepted, n_rejected): rejection about a robust line through a cell's ranked samples, then the weighted mean.

    A round fits a least-absolute-deviation line to the sorted samples over their ranks, its slope by bisection and its
    intercept as the median of what remains, and drops samples farther from it than `low` below or `high` above in
    units of twice the mean deviation times sqrt(1 + slope^2).  Rounds end when nothing is dropped, under five samples are
    left or the scale is lost in rounding.  Samples of no weight, and those that are not finite, do not count.
    One shuffle by the keys; a task holds the samples of a batch of cells.
    """
    import numpy as np
    import pyarrow as pa

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*keys, clean(value).alias("v"), w.alias("w")).where("v is not null and w > 0")
    cells = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("s"))

    def fitted(x: np.ndarray) -> tuple[float, float, float]:
        rank, lo, up = np.arange(len(x)), 0.0, max(1e-12, 4.0 * (x[-1] - x[0]) / (len(x) - 1))
        for _ in range(bisections):
            slope = 0.5 * (lo + up)
            middle = np.median(x - slope * rank)
            if (rank * np.sign(x - (middle + slope * rank))).sum() > 0:
                lo = slope
            else:
                up = slope
        slope = 0.5 * (lo + up)
        middle = np.median(x - slope * rank)
        return middle, slope, np.abs(x - (middle + slope * rank)).sum() / len(x)

    def reduced(x: np.ndarray, weights: np.ndarray) -> tuple[int, float, int, int]:
        n = len(x)
        for _ in range(rounds):
            if len(x) < 5:
                break
            middle, slope, spread = fitted(x)
            scale = 2.0 * spread * np.sqrt(1.0 + slope * slope)
            if not scale > 0 or 1.0 + scale == 1.0:
                break
            off = (x - (middle + slope * np.arange(len(x)))) / scale
            keep = (off >= -low) & (off <= high)
            if keep.all():
                break
            x, weights = x[keep], weights[keep]
        return n, float((weights * x).sum() / weights.sum()) if len(x) else None, len(x), n - len(x)

    def run(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            inside, ends = lists.values, lists.offsets.to_numpy()
            v, weights = inside.field(0).to_numpy(), inside.field(1).to_numpy()
            out = [reduced(v[a:b], weights[a:b]) for a, b in zip(ends, ends[1:])]
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], [*keys, "n", "mean", "n_accepted", "n_rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name != "s")
    return cells.mapInArrow(run, f"{schema}, n long, mean double, n_accepted long, n_rejected long")
