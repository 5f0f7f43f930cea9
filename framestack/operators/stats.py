"""Robust statistics that skip nulls and NaN.  Percentiles are exact and interpolate linearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MADN = 1.4826


def clean(c: Column | str) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def over(keys: list[str]):
    return Window.partitionBy(*keys)


def with_median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with n, med and mad of each group's finite values: one shuffle by the keys, used by both windows."""
    w = over(keys)
    v = clean(value)
    df = df.withColumns({"n": F.count(v).over(w), "med": F.percentile(v, F.lit(0.5)).over(w)})
    return df.withColumn("mad", F.percentile(F.abs(v - F.col("med")), F.lit(0.5)).over(w))


def robust_z(df: DataFrame, keys: list[str], value: str, out: str = "z") -> DataFrame:
    """Deviation from the group median in MADN; null where the spread is zero."""
    df = with_median_mad(df, keys, value)
    return df.withColumn(out, F.when(F.col("mad") > 0, (clean(value) - F.col("med")) / (MADN * F.col("mad"))))


def envelope(df: DataFrame, keys: list[str], value: str, share: float = 0.10, low: bool = True) -> DataFrame:
    """(keys, n, envelope): the median of the ceil(share n) lowest (or highest) values, at least one."""
    v = clean(value)
    rows = df.where(v.isNotNull()).withColumn("v", v)
    order = F.col("v").asc() if low else F.col("v").desc()
    rows = rows.withColumns({"rank": F.row_number().over(over(keys).orderBy(order)), "n": F.count("*").over(over(keys))})
    kept = rows.where(F.col("rank") <= F.ceil(F.round(F.col("n") * share, 9)))
    return kept.groupBy(*keys).agg(F.max("n").alias("n"), F.percentile("v", F.lit(0.5)).alias("envelope"))


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str, order: str, min_dx: float = 0.0, slope_limit: float | None = None) -> DataFrame:
    """(keys, pairs, slope, intercept): medians of pair slopes and of y - slope x.

    Pairs are made within a group only; those closer than min_dx in x, or steeper than slope_limit, are left out.
    """
    rows = df.select(*keys, clean(x).alias("x"), clean(y).alias("y"), F.col(order).alias("o")).where("x is not null and y is not null")
    a, b = rows, rows.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("o").alias("o2"))
    dx = F.col("x2") - F.col("x")
    pairs = a.join(b, keys).where((F.col("o") < F.col("o2")) & (F.abs(dx) >= min_dx) & (dx != 0)).withColumn("slope", F.try_divide(F.col("y2") - F.col("y"), dx))
    if slope_limit is not None:
        pairs = pairs.where(F.abs("slope") <= slope_limit)
    slopes = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.percentile("slope", F.lit(0.5)).alias("slope"))
    return rows.join(slopes, keys).groupBy(*keys).agg(F.first("pairs").alias("pairs"), F.first("slope").alias("slope"), F.percentile(F.col("y") - F.col("slope") * F.col("x"), F.lit(0.5)).alias("intercept"))


#: Values of one list of pair_slopes(), thresholds of a round, and slopes between the wanted ranks that are written out.
LIST, GRID, FEW = 4096, 32, 2_000_000


def pair_slopes(df: DataFrame, keys: list[str], within: str, x: str, y: str, min_dx: float, steepest: float) -> DataFrame:
    """(keys, pairs, slope): count and median of the slopes of all pairs of one `within`, apart by min_dx in x, at most `steepest`.

    Pairs are counted, not made: the rows of one x are lists of rising y with their numbers, and for two lists the slopes up to
    a threshold follow from searches.  Rounds of GRID thresholds narrow the median until at most FEW slopes are left, which are
    made.  The work grows with the distinct x of a `within` squared and with the lists' lengths, a task holds two lists.  The slopes are
    those of (y2 - y1) / (x2 - x1) in double precision, to the last bit.
    """
    import numpy as np
    import pyarrow as pa

    from .joins import cut, held

    points = df.select(*keys, F.col(within).alias("_w"), F.col(x).alias("x"), F.col(y).alias("y")).groupBy(*keys, "_w", "x", "y").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_w", "x").orderBy("y"))
    lists = points.withColumn("_k", F.floor((rank - 1) / LIST)).groupBy(*keys, "_w", "x", "_k").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("s"))  # at most LIST values
    lists = cut(lists.select(*keys, "_w", "x", F.col("s.y").alias("y"), F.col("s.n").alias("n")))
    other = lists.withColumnsRenamed({"x": "x2", "y": "y2", "n": "n2"})
    met = lists.join(other.hint("merge"), [*keys, "_w"]).where((F.col("x") < F.col("x2")) & (F.col("x2") - F.col("x") >= min_dx)).drop("_w")
    spark = df.sparkSession
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def at_most(y1, y2, dx, t):
        """For each threshold (rows) and y1 (columns) how many of y2 have a slope up to it; the division decides, as slopes rise with y2."""
        place = np.searchsorted(y2, y1[None] + t[:, None] * dx, "right")
        while True:
            here = y2[np.minimum(place, len(y2) - 1)] - y1[None]
            up = (place < len(y2)) & (here / dx <= t[:, None])
            down = (place > 0) & ((y2[np.maximum(place - 1, 0)] - y1[None]) / dx > t[:, None])
            if not (up | down).any():
                return place
            place = place + up - down

    def counted(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                y1, n1, y2, n2 = (batch.column(c)[r].values.to_numpy() for c in ("y", "n", "y2", "n2"))
                t = batch.column("_t")[r].values.to_numpy()
                upto = np.concatenate([[0], np.cumsum(n2)])[at_most(y1, y2, batch.column("x2")[r].as_py() - batch.column("x")[r].as_py(), t)]
                out.append((upto * n1).sum(1))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(out, pa.list_(pa.int64()))], [*keys, "c"])

    def made(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = [[] for _ in range(len(keys) + 2)]
            for r in range(batch.num_rows):
                y1, n1, y2, n2 = (batch.column(c)[r].values.to_numpy() for c in ("y", "n", "y2", "n2"))
                dx = batch.column("x2")[r].as_py() - batch.column("x")[r].as_py()
                a, b = at_most(y1, y2, dx, np.array([batch.column("lo")[r].as_py(), batch.column("hi")[r].as_py()]))
                many = np.maximum(b - a, 0)
                one = np.repeat(np.arange(len(y1)), many)
                two = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - a, many)
                slopes, at = np.unique((y2[two] - y1[one]) / dx, return_inverse=True)
                n = np.zeros(len(slopes), np.int64)
                np.add.at(n, at, n2[two] * n1[one])
                for k, column in enumerate((*[batch.column(k).take(pa.array(np.full(len(slopes), r))) for k in keys], pa.array(slopes), pa.array(n))):
                    out[k].append(column)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(column) for column in out], [*keys, "v", "c"])

    below = float(np.nextafter(-steepest, -np.inf))
    bounds = held(lists.select(*keys).distinct().withColumns({"lo": F.lit(below), "hi": F.lit(float(steepest)), "below": F.lit(None).cast("long"), "pairs": F.lit(None).cast("long"), "left": F.lit(None).cast("long")}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        while True:
            steps = F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: F.when(i == 0, F.col("lo")).when(i == GRID, F.col("hi")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * i / GRID))
            asked = bounds.select(*keys, steps.alias("_t"))
            tallies = met.join(F.broadcast(asked), keys).mapInArrow(counted, f"{kinds}, c array<long>").select(*keys, F.posexplode("c"))
            tallies = tallies.groupBy(*keys, "pos").agg(F.sum("col").alias("n"))
            sums = cut(tallies.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("c")).select(*keys, F.col("c.n").alias("c")))
            got = bounds.join(sums, keys).withColumns({"_t": steps})
            zero = F.get("c", F.lit(0))
            got = got.withColumns({"base": F.when(F.col("pairs").isNull(), zero).otherwise(F.col("below")), "pairs": F.coalesce("pairs", F.get("c", F.lit(GRID)) - zero)})
            # `base` is what lies below the first round's range; ranks count from there.
            first = F.col("base") + F.floor((F.col("pairs") - 1) / 2)
            last = F.col("base") + F.ceil((F.col("pairs") - 1) / 2)
            low = F.greatest(F.lit(0), F.size(F.filter("c", lambda v: v <= first)) - 1)
            high = F.least(F.lit(GRID), F.size(F.filter("c", lambda v: v <= last)))
            got = got.select(*keys, F.get("_t", low).alias("lo"), F.get("_t", high).alias("hi"), F.col("base").alias("below"), "pairs", (F.get("c", high) - F.get("c", low)).alias("left"), F.get("c", low).alias("start"), (F.get("_t", high) - F.get("_t", low)).alias("wide"))
            bounds = held(got)
            if not bounds.where((F.col("left") > FEW) & (F.col("wide") > 1e-12)).head(1):
                break
        slopes = met.join(F.broadcast(bounds.select(*keys, "lo", "hi")), keys).mapInArrow(made, f"{kinds}, v double, c long").groupBy(*keys, "v").agg(F.sum("c").alias("c"))
        slopes = cut(slopes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ranked = slopes.join(bounds, keys).withColumn("upto", F.col("start") - F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    half = ranked.groupBy(*keys).agg(at(F.floor((F.col("pairs") - 1) / 2)).alias("a"), at(F.ceil((F.col("pairs") - 1) / 2)).alias("b"))
    return bounds.where("pairs > 0").select(*keys, "pairs").join(half, keys).select(*keys, "pairs", (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("slope"))


def best_low(value: Column) -> Column:
    """max(min, p10): the best of a low-is-good measure, guarded against a single lucky value."""
    return F.greatest(F.min(value), F.percentile(value, F.lit(0.1)))


def best_high(value: Column, n: int = 10) -> Column:
    """p90 with at least n values, the maximum with fewer."""
    return F.when(F.count(value) >= n, F.percentile(value, F.lit(0.9))).otherwise(F.max(value))


def coherence(theta: Column, weight: Column) -> Column:
    """|sum w e^(2i theta)| / sum w of orientations."""
    return F.sqrt(F.pow(F.sum(weight * F.cos(2 * theta)), 2) + F.pow(F.sum(weight * F.sin(2 * theta)), 2)) / F.nullif(F.sum(weight), F.lit(0.0))


#: Samples between the wanted ranks above which exact_quantile() counts once more, and how often it does at most.
NARROW, ROUNDS = 1_000_000, 8


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, bins: int = 4096) -> DataFrame:
    """(keys, quantile): exact also where one group holds a large share of all rows.

    Values are counted in equal bins, which combine before the shuffle, and so are those of the bins that hold the two wanted
    ranks, until few are left; then only the distinct values of these bins are ranked.  Bounds of groups are held(), so that
    no task gathers a group's rows.
    """
    from .joins import held

    rows = df.select(*keys, clean(value).alias("v")).where("v is not null")
    span = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = (F.col("n") - 1) * q
    want = held(span.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("below"), F.floor(place).alias("r0"), F.ceil(place).alias("r1"), (place - F.floor(place)).alias("f")))
    step = (F.col("hi") - F.col("lo")) / bins
    run = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(ROUNDS):
        joined = rows.join(want, keys).where("v >= lo and v <= hi")
        binned = joined.withColumn("bin", F.when(step > 0, F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0))
        counts = binned.groupBy(*keys, "below", "r0", "r1", "f", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counts = counts.withColumn("upto", F.col("below") + F.sum("c").over(run)).withColumn("start", F.col("upto") - F.col("c"))
        near = counts.where((F.col("upto") > F.col("r0")) & (F.col("start") <= F.col("r1")))
        want = held(near.groupBy(*keys, "r0", "r1", "f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("start").alias("below"), F.sum("c").alias("c")))
        if not want.where((F.col("c") > NARROW) & (F.col("hi") > F.col("lo"))).head(1):
            break
    left = rows.join(want, keys).where("v >= lo and v <= hi")
    distinct = left.groupBy(*keys, "below", "r0", "r1", "f", "v").agg(F.count("*").alias("c"))
    run = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("upto", F.col("below") + F.sum("c").over(run)).withColumn("start", F.col("upto") - F.col("c"))
    at = lambda r: F.min(F.when((F.col("upto") > F.col(r)) & (F.col("start") <= F.col(r)), F.col("v")))
    got = ranked.groupBy(*keys, "f").agg(at("r0").alias("a"), at("r1").alias("b"))
    return got.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("quantile"))
