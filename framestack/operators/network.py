"""Network fits: panel gains and offsets from overlaps, by sums in Spark and small solves on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Panels of one mosaic; a solve has one unknown a panel.
MOST_PANELS = 5000


def panel_offsets(edges: DataFrame, a: str, b: str, difference: str, weight: str, prior: float = 1e-6, huber: float = 1.5, passes: int = 4) -> dict:
    """Offsets g with g[a] - g[b] near the measured differences, mean zero: robust weighted least squares.

    The normal equations are sums over edges, made in Spark for each re-weighting; the driver holds
    one number an unknown and solves.
    """
    nodes = [r[0] for r in edges.select(F.col(a).alias("n")).union(edges.select(b)).distinct().orderBy("n").limit(MOST_PANELS + 1).collect()]
    if len(nodes) > MOST_PANELS:
        raise ValueError("too many panels for one solve; fit connected parts apart")
    at = {n: i for i, n in enumerate(nodes)}
    found = np.zeros(len(nodes))
    for _ in range(passes):
        table = edges.sparkSession.createDataFrame([(n, float(found[i])) for n, i in at.items()], ["node", "g"]) if nodes else None
        if table is None:
            return {}
        ga, gb = table.select(F.col("node").alias(a), F.col("g").alias("ga")), table.select(F.col("node").alias(b), F.col("g").alias("gb"))
        rows = edges.join(F.broadcast(ga), a).join(F.broadcast(gb), b)
        r = F.abs(F.col(difference) - (F.col("ga") - F.col("gb"))) * F.sqrt(weight)
        w = F.col(weight) * F.when(r > huber, huber / r).otherwise(1.0)
        sums = rows.groupBy(a, b).agg(F.sum(w).alias("w"), F.sum(w * F.col(difference)).alias("wd")).collect()
        normal, right = prior * np.eye(len(nodes)), np.zeros(len(nodes))
        for u, v, s, d in sums:
            i, j = at[u], at[v]
            normal[i, i] += s
            normal[j, j] += s
            normal[i, j] -= s
            normal[j, i] -= s
            right[i] += d
            right[j] -= d
        new = np.linalg.solve(normal, right)
        new -= new.mean()
        if np.abs(new - found).max() < 1e-12:
            break
        found = new
    return {n: float(found[i]) for n, i in at.items()}


def bic(n: int, rss: float, parameters: int) -> float:
    """Bayesian information criterion of a Gaussian fit."""
    return n * float(np.log(max(rss, 1e-300) / max(n, 1))) + parameters * float(np.log(max(n, 1)))


def super_channel(df: DataFrame, channel: str, cell: list[str], value: str, reference: str) -> DataFrame:
    """(channel, scale, noise, weight): share of each channel in a combined luminance.

    scale is the median ratio to the reference channel over common cells; noise is the robust spread
    of neighbour differences; weights go as (scale / noise) squared and sum to one.
    """
    from .stats import MADN, clean, with_median_mad
    from pyspark.sql import Window

    v = clean(value)
    ref = df.where(F.col(channel) == reference).select(*cell, v.alias("_ref"))
    ratio = df.join(ref, cell).where("_ref > 0").groupBy(channel).agg(F.percentile(F.try_divide(v, F.col("_ref")), F.lit(0.5)).alias("scale"))
    steps = df.withColumn("_d", v - F.lag(v).over(Window.partitionBy(channel, *cell[:-1]).orderBy(cell[-1])))
    noise = with_median_mad(steps, [channel], "_d").groupBy(channel).agg((MADN * F.max("mad") / F.sqrt(F.lit(2.0))).alias("noise"))
    both = ratio.join(noise, channel).withColumn("_w", F.pow(F.col("scale") / F.nullif(F.col("noise"), F.lit(0.0)), 2))
    total = both.agg(F.sum("_w").alias("_t"))
    return both.crossJoin(F.broadcast(total)).select(channel, "scale", "noise", (F.col("_w") / F.col("_t")).alias("weight"))
