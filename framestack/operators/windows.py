"""Nights, sessions, peers and other windowed measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import MADN, clean, over, pair_slopes, with_median_mad


def night(ts: Column, zone: str = "UTC", hours: int = 12) -> Column:
    """The observing night: the local date of `hours` before."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone) - F.expr(f"INTERVAL {hours} HOURS"))


def gap_blocks(df: DataFrame, keys: list[str], ts: str, gap_seconds: float = 7200.0, tie: str | None = None, out: str = "block") -> DataFrame:
    """df with the number (from 0) of each row's block: a new one starts after a gap longer than gap_seconds."""
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    df = df.withColumn("_new", F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds).cast("int"), F.lit(0)))
    return df.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str = "2 hours") -> DataFrame:
    """(keys, session_start, session_end, n): a session ends where the gap is met or passed."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    out = rows.groupBy(*keys, F.session_window("_ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def without_self(df: DataFrame, keys: list[str], value: str, share: float = 0.10) -> DataFrame:
    """df with peer_low, peer_median and peer_high of the group's other rows; null where there is none.

    Leaving out the row of rank r moves every later rank down by one, so an order statistic of the
    others is one of two of the whole group: a few ranks a group serve all its rows, without a self-join.
    """
    w = over(keys)
    rows = df.withColumn("_v", clean(value))
    rows = rows.withColumns({"_n": F.count("_v").over(w), "_r": F.row_number().over(w.orderBy(F.col("_v").asc_nulls_last()))})
    known = F.col("_v").isNotNull()

    def places(m: Column) -> dict[str, tuple[Column, Column]]:
        """First and last rank of the ranges whose medians are wanted, among m rows."""
        k = F.greatest(F.lit(1), F.ceil(F.round(m * share, 9)))
        return {"peer_low": (F.lit(1), k), "peer_median": (F.lit(1), m), "peer_high": (m - k + 1, m)}

    def whole(rank: Column) -> Column:
        return F.max(F.when((F.col("_r") == rank) & known, F.col("_v"))).over(w)

    out = {}
    for name in ("peer_low", "peer_median", "peer_high"):
        others, everyone = places(F.col("_n") - 1)[name], places(F.col("_n"))[name]
        got = []
        for side in (F.floor, F.ceil):
            at = side((others[0] + others[1]) / 2)
            own = F.when(F.col("_r") <= at, whole(at + 1)).otherwise(whole(at))
            got.append(F.when(known, own).otherwise(whole(side((everyone[0] + everyone[1]) / 2))))
        out[name] = F.when(F.col("_n") - known.cast("int") > 0, (got[0] + got[1]) / 2)
    return rows.withColumns(out).drop("_v", "_n", "_r")


def peer_scale(df: DataFrame, cohort: list[str], night: str, value: str, few: int = 5, share: float = 0.02) -> DataFrame:
    """(cohort, night, n, center, scale): MADN of the night, at least `share` of the center and, with few rows, the cohort's MADN."""
    wide = with_median_mad(df, cohort, value).groupBy(*cohort).agg((MADN * F.max("mad")).alias("cohort_madn"))
    nights = with_median_mad(df, [*cohort, night], value).groupBy(*cohort, night).agg(F.max("n").alias("n"), F.max("med").alias("center"), (MADN * F.max("mad")).alias("madn"))
    scale = F.greatest(F.col("madn"), share * F.abs("center"), F.when(F.col("n") < few, F.col("cohort_madn")))
    return nights.join(wide, cohort).select(*cohort, night, "n", "center", scale.alias("scale"))


def score_z(df: DataFrame, keys: list[str], score: str, floor: float = 0.05, out: str = "score_z") -> DataFrame:
    """df with the robust z of log10(score), the MADN floored."""
    rows = df.withColumn("_log", F.when(F.col(score) > 0, F.log10(score)))
    rows = with_median_mad(rows, keys, "_log")
    return rows.withColumn(out, (F.col("_log") - F.col("med")) / F.greatest(MADN * F.col("mad"), F.lit(floor))).drop("_log", "n", "med", "mad")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """df's first k rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(over(keys).orderBy(*order))).where(F.col("rank") <= k)


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order (which must be total): an aggregate, so nothing is sorted."""
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_row"))
    return packed.select(*keys, "_row.*")


def soft_guard(df: DataFrame, keys: list[str], soft: Column, value: str, tie: str, share: float = 0.5, least: int = 2) -> DataFrame:
    """df with `dropped`: soft rows by rising value (null first) until max(least, ceil(share n)) rows remain."""
    w = over(keys)
    rows = df.withColumn("_soft", F.coalesce(soft, F.lit(False)))
    rank = F.row_number().over(w.orderBy(F.col("_soft").desc(), F.col(value).asc_nulls_first(), F.col(tie)))
    n = F.count("*").over(w)
    return rows.withColumn("dropped", F.col("_soft") & (rank <= n - F.greatest(F.lit(least), F.ceil(F.round(n * share, 9))))).drop("_soft")


def night_extinction(df: DataFrame, night: str, airmass: str, extinction: str, order: str, least_dx: float = 0.05, steepest: float = 2.0, slopes: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """df with slope, corrected, night_offset, residual and reliable of the extinction of nights.

    The slope is the median over pairs within one night, clamped; a night's offset is the envelope of
    its lowest tenth of corrected values.
    """
    rows = df.withColumns({"_x": clean(airmass), "_y": clean(extinction)})
    a = rows.where("_x is not null and _y is not null").select(F.col(night).alias("n1"), F.col("_x").alias("x1"), F.col("_y").alias("y1"))
    known = a.where(F.col("n1").isNotNull()).withColumn("_all", F.lit(0))
    fit = pair_slopes(known, ["_all"], "n1", "x1", "y1", least_dx, steepest).agg(F.coalesce(F.max("pairs"), F.lit(0)).alias("pairs"), F.max("slope").alias("raw"))
    valid = a.groupBy("n1").agg(F.count("*").alias("c"), (F.max("x1") - F.min("x1")).alias("span")).agg(F.sum("c").alias("valid"), F.max("span").alias("span"))
    model = fit.crossJoin(valid).select(
        F.greatest(F.least("raw", F.lit(slopes[1])), F.lit(slopes[0])).alias("slope"),
        (F.coalesce(F.col("valid") >= 4, F.lit(False)) & (F.col("pairs") >= 3) & F.coalesce(F.col("span") >= 0.20, F.lit(False)) & F.col("raw").isNotNull()).alias("reliable"),
    )
    rows = rows.crossJoin(F.broadcast(model)).withColumn("corrected", F.col("_y") - F.coalesce("slope", F.lit(0.0)) * (F.col("_x") - 1))
    from .stats import envelope

    low = envelope(rows, [night], "corrected").select(night, F.col("envelope").alias("night_offset"))
    return rows.join(low, night, "left").withColumn("residual", F.col("corrected") - F.col("night_offset")).drop("_x", "_y")
