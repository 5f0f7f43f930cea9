"""Registration of star lists by similarities: triangles, votes, consensus, refinement, acceptance.

A similarity maps (x, y) to (a x - b y + tx, b x + a y + ty).  Both sides hold (keys, id, x, y, flux);
the keys name a pair of frames, so all pairs are registered together in a few shuffles by the keys.
What a pair of frames costs is bounded by the control stars, not by all stars: `CONTROL` stars give at
most 10 triangles each, and `SEEDS` votes give the hypotheses, which are all tried (no random draws).
Stars without finite coordinates are left out; of stars at one place the brightest stays, ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins
from .stats import clean

# Control stars, neighbours of a triangle, invariant radius, pixels of a triangle's fit.
CONTROL, NEIGHBOURS, INVARIANT, PIXELS = 100, 4, 0.1, 2.0
# Match radius, residual of an inlier, and what acceptance asks for.
MATCH, RESIDUAL, LEAST_INLIERS, LEAST_RATIO, MOST_RMS = 5.0, 3.0, 12, 0.25, 2.5
#: Correspondences with most votes, whose pairs are the hypotheses.
SEEDS = 24
#: Two stars nearer than this make no hypothesis.
LEAST_BASE = 1.0
MODEL = ("a", "b", "tx", "ty")


def catalogue(stars: DataFrame, keys: list[str], pid: str, x: str, y: str, flux: str) -> DataFrame:
    """(keys, id, x, y, flux): finite, distinct places, the brightest star of each."""
    rows = stars.select(*keys, F.col(pid).alias("id"), clean(x).alias("x"), clean(y).alias("y"), clean(flux).alias("flux")).where("x is not null and y is not null")
    order = Window.partitionBy(*keys, "x", "y").orderBy(F.col("flux").desc_nulls_last(), "id")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def local_triangles(stars: DataFrame, keys: list[str], top: int = CONTROL) -> DataFrame:
    """(keys, r1, r2, v array of (x, y, id)): triangles of each control star and its four nearest, each once.

    The corners lie opposite the longest, the middle and the shortest side; r1 and r2 are longest over
    middle and middle over shortest side.
    """
    bright = Window.partitionBy(*keys).orderBy(F.col("flux").desc_nulls_last(), "id")
    p = stars.withColumn("_k", F.row_number().over(bright)).where(F.col("_k") <= top).select(*keys, F.struct("x", "y", "id").alias("p"))
    # At most top squared rows a key: the control stars only.
    met = p.join(p.withColumnRenamed("p", "q"), keys).where("p.id <> q.id")
    gap = F.pow(F.col("p.x") - F.col("q.x"), 2) + F.pow(F.col("p.y") - F.col("q.y"), 2)
    near = Window.partitionBy(*keys, "p").orderBy(gap, "q.id")
    star = met.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= NEIGHBOURS).groupBy(*keys, "p").agg(F.collect_list("q").alias("q"))
    star = star.select(*keys, F.array_sort(F.concat(F.array("p"), "q")).alias("s"))
    picks = F.array(*[F.array(F.lit(i), F.lit(j), F.lit(k)) for i in range(5) for j in range(i + 1, 5) for k in range(j + 1, 5)])
    corner = lambda i: F.get("s", F.get("_p", F.lit(i)))
    rows = star.withColumn("_p", F.explode(picks)).select(*keys, *[corner(i).alias(n) for i, n in enumerate("abc")]).where("c is not null").distinct()
    side = lambda m, n: F.sqrt(F.pow(F.col(f"{m}.x") - F.col(f"{n}.x"), 2) + F.pow(F.col(f"{m}.y") - F.col(f"{n}.y"), 2))
    ends = F.array(*[F.struct(side(m, n).alias("d"), F.col(o).alias("v")) for m, n, o in ("abc", "bca", "cab")])
    rows = rows.select(*keys, F.reverse(F.array_sort(ends)).alias("e"))
    d = lambda i: F.get("e", F.lit(i))["d"]
    return rows.where(d(2) > 0).select(*keys, F.try_divide(d(0), d(1)).alias("r1"), F.try_divide(d(1), d(2)).alias("r2"), F.col("e.v").alias("v"))


def _similarity(sx: str, sy: str, rx: str, ry: str) -> dict[str, Column]:
    """The least-squares similarity of point pairs as aggregates; null where the source points coincide."""
    spread = F.var_pop(sx) + F.var_pop(sy)
    a = F.try_divide(F.covar_pop(sx, rx) + F.covar_pop(sy, ry), spread)
    b = F.try_divide(F.covar_pop(sx, ry) - F.covar_pop(sy, rx), spread)
    return {"a": a, "b": b, "tx": F.avg(rx) - a * F.avg(sx) + b * F.avg(sy), "ty": F.avg(ry) - b * F.avg(sx) - a * F.avg(sy)}


def fit_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, a, b, tx, ty) of pairs (keys, sx, sy, rx, ry): one aggregation, combined before the shuffle."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in _similarity("sx", "sy", "rx", "ry").items()]).where("a is not null")


def moved(x: Column, y: Column) -> tuple[Column, Column]:
    """(x, y) under the model in the columns a, b, tx, ty."""
    a, b, tx, ty = (F.col(c) for c in MODEL)
    return a * x - b * y + tx, b * x + a * y + ty


def _error(sx: str, sy: str, rx: str, ry: str) -> Column:
    x, y = moved(F.col(sx), F.col(sy))
    return F.sqrt(F.pow(x - F.col(rx), 2) + F.pow(y - F.col(ry), 2))


def correspondences(source: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_id, right_id, sx, sy, rx, ry, votes): stars that vote for each other most, by triangles of like shape.

    A pair of triangles votes for its corners if one similarity brings all three within two pixels.
    """
    s, t = local_triangles(source, keys), local_triangles(reference, keys)
    cell = lambda c: F.floor(F.col(c) / INVARIANT)
    s = s.withColumns({"_i": cell("r1"), "_j": cell("r2")})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # Corners about their mean are made on each side of the join, so that the fit behind it stays a small expression.
    at = lambda i, c: F.get("v", F.lit(i))[c]
    mean = lambda c: (at(0, c) + at(1, c) + at(2, c)) / 3
    centred = F.named_struct(*[e for i in range(3) for c in "xy" for e in (F.lit(f"{c}{i}"), at(i, c) - mean(c))])
    s = s.withColumn("g", centred)
    t = t.select(*keys, F.col("r1").alias("q1"), F.col("r2").alias("q2"), F.col("v").alias("w"), centred.alias("h"), F.explode(steps).alias("_s"))
    t = t.withColumns({"_i": cell("q1") + F.col("_s.i"), "_j": cell("q2") + F.col("_s.j")}).drop("_s")
    met = s.join(t, [*keys, "_i", "_j"]).where(F.pow(F.col("r1") - F.col("q1"), 2) + F.pow(F.col("r2") - F.col("q2"), 2) <= INVARIANT**2)
    total = lambda f: f(0) + f(1) + f(2)
    dx, dy, ex, ey = ((lambda i, n=n: F.col(f"{n[0]}.{n[1]}{i}")) for n in ("gx", "gy", "hx", "hy"))
    met = met.withColumn("_n", total(lambda i: dx(i) * dx(i) + dy(i) * dy(i)))
    met = met.withColumns({"a": F.try_divide(total(lambda i: dx(i) * ex(i) + dy(i) * ey(i)), F.col("_n")), "b": F.try_divide(total(lambda i: dx(i) * ey(i) - dy(i) * ex(i)), F.col("_n"))})
    off = lambda i: F.pow(F.col("a") * dx(i) - F.col("b") * dy(i) - ex(i), 2) + F.pow(F.col("b") * dx(i) + F.col("a") * dy(i) - ey(i), 2)
    met = met.where(F.greatest(off(0), off(1), off(2)) <= PIXELS**2)
    each = met.select(*keys, F.explode(F.arrays_zip("v", "w")).alias("c")).select(*keys, F.col("c.v").alias("v"), F.col("c.w").alias("w"))
    votes = each.groupBy(*keys, "v", "w").agg(F.count("*").alias("votes"))
    first = lambda side: F.row_number().over(Window.partitionBy(*keys, f"{side}.id").orderBy(F.col("votes").desc(), "v.id", "w.id"))
    best = votes.withColumns({"_l": first("v"), "_r": first("w")}).where("_l = 1 and _r = 1")
    return best.select(*keys, F.col("v.id").alias("left_id"), F.col("w.id").alias("right_id"), F.col("v.x").alias("sx"), F.col("v.y").alias("sy"), F.col("w.x").alias("rx"), F.col("w.y").alias("ry"), "votes")


def consensus(pairs: DataFrame, keys: list[str], residual: float = RESIDUAL) -> DataFrame:
    """(keys, n, a, b, tx, ty): the similarity of two of the most voted pairs that most pairs agree with, fitted to those.

    At most SEEDS (SEEDS - 1) / 2 hypotheses a key, each held against the key's pairs (one a control star).
    """
    order = Window.partitionBy(*keys).orderBy(F.col("votes").desc(), "left_id")
    seed = pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= SEEDS)
    one = seed.select(*keys, F.col("_k").alias("k1"), *[F.col(c).alias(f"{c}1") for c in ("sx", "sy", "rx", "ry")])
    two = seed.select(*keys, F.col("_k").alias("k2"), *[F.col(c).alias(f"{c}2") for c in ("sx", "sy", "rx", "ry")])
    d = lambda c: F.col(f"{c}2") - F.col(f"{c}1")
    h = one.join(two, keys).where("k1 < k2").withColumn("_n", d("sx") * d("sx") + d("sy") * d("sy")).where(F.col("_n") >= LEAST_BASE**2)
    h = h.withColumns({"a": F.try_divide(d("sx") * d("rx") + d("sy") * d("ry"), F.col("_n")), "b": F.try_divide(d("sx") * d("ry") - d("sy") * d("rx"), F.col("_n"))})
    h = h.withColumns({"tx": F.col("rx1") - F.col("a") * F.col("sx1") + F.col("b") * F.col("sy1"), "ty": F.col("ry1") - F.col("b") * F.col("sx1") - F.col("a") * F.col("sy1")})
    h = h.select(*keys, "k1", "k2", *MODEL)
    held = h.join(pairs, keys).withColumn("_e", _error("sx", "sy", "rx", "ry")).where(F.col("_e") <= residual)
    score = held.groupBy(*keys, "k1", "k2", *MODEL).agg(F.count("*").alias("n"), F.sum("_e").alias("_s"))
    best = score.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "_s", "k1", "k2"))).where("_k = 1").select(*keys, *MODEL)
    agreed = pairs.join(best, keys).where(_error("sx", "sy", "rx", "ry") <= residual).select(*keys, "sx", "sy", "rx", "ry")
    return fit_similarity(agreed, keys)


def matched(source: DataFrame, reference: DataFrame, model: DataFrame, keys: list[str], radius: float = MATCH, greedy: bool = False) -> DataFrame:
    """(keys, left_id, right_id, sx, sy, rx, ry, residual): one-to-one matches of all stars under the model.

    Mutual nearest, or by rising distance until no pair within the radius is left (`greedy`).
    """
    x, y = moved(F.col("x"), F.col("y"))
    s = source.join(model.select(*keys, *MODEL), keys).select(*keys, "id", F.col("x").alias("sx"), F.col("y").alias("sy"), x.alias("x"), y.alias("y"))
    pairs = joins.radius_pairs(s, reference, keys, "id", "id", "x", "y", radius)
    pairs = joins.greedy_match(pairs, keys) if greedy else joins.mutual_nearest(pairs, keys)
    left = s.select(*keys, F.col("id").alias("left_id"), "sx", "sy")
    right = reference.select(*keys, F.col("id").alias("right_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return pairs.join(left, [*keys, "left_id"]).join(right, [*keys, "right_id"]).withColumnRenamed("distance", "residual")


def register(source: DataFrame, reference: DataFrame, keys: list[str], pid: str, x: str, y: str, flux: str) -> DataFrame:
    """(keys, source_count, reference_count, a, b, tx, ty, matches, inliers, inlier_ratio, rms, accepted, reasons).

    One row for each key of the source.  Without three stars on both sides the reason is
    INSUFFICIENT_STARS_FOR_ESTIMATE, without a model TRANSFORM_NOT_FOUND, with fewer than two matches
    TOO_FEW_MATCHES; the model is null then.  Refinement takes mutual nearest stars twice, the last
    match is one-to-one by rising distance.
    """
    s = joins.cut(catalogue(source, keys, pid, x, y, flux))
    t = joins.cut(catalogue(reference, keys, pid, x, y, flux))
    number = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    counts = source.select(*keys).distinct().join(number(s, "source_count"), keys, "left").join(number(t, "reference_count"), keys, "left").na.fill(0, ["source_count", "reference_count"])
    enough = joins.cut(counts.where("source_count >= 3 and reference_count >= 3").select(*keys))
    model = joins.cut(consensus(joins.cut(correspondences(s.join(enough, keys, "left_semi"), t.join(enough, keys, "left_semi"), keys)), keys))
    found = model.select(*keys, F.lit(True).alias("_found"))
    for _ in range(3):
        model = joins.cut(fit_similarity(matched(s, t, model, keys).where(F.col("residual") <= RESIDUAL), keys))
    final = matched(s, t, model, keys, greedy=True)
    inlier = F.col("residual") <= RESIDUAL
    quality = final.groupBy(*keys).agg(F.count("*").alias("matches"), F.count_if(inlier).alias("inliers"), F.sqrt(F.avg(F.when(inlier, F.pow("residual", F.lit(2))))).alias("rms"))
    out = counts.join(found, keys, "left").join(model.drop("n"), keys, "left").join(quality, keys, "left").na.fill(0, ["matches", "inliers"])
    few = F.least("source_count", "reference_count")
    out = out.withColumn("inlier_ratio", F.coalesce(F.try_divide("inliers", few), F.lit(0.0)))
    failed = (
        F.when(few < 3, "INSUFFICIENT_STARS_FOR_ESTIMATE").when(F.col("_found").isNull(), "TRANSFORM_NOT_FOUND").when(F.col("matches") < 2, "TOO_FEW_MATCHES")
    )
    judged = F.array_compact(
        F.array(F.when(F.col("inliers") < LEAST_INLIERS, "INSUFFICIENT_INLIERS"), F.when(F.col("inlier_ratio") < LEAST_RATIO, "LOW_INLIER_RATIO"), F.when(F.coalesce(F.col("rms") > MOST_RMS, F.lit(True)), "HIGH_RMS"))
    )
    out = out.withColumn("reasons", F.when(failed.isNotNull(), F.array(failed)).otherwise(judged))
    kept = [F.when(failed.isNull(), F.col(c)).alias(c) for c in (*MODEL, "rms")]
    return out.select(*keys, "source_count", "reference_count", *kept[:4], "matches", "inliers", "inlier_ratio", kept[4], (F.size("reasons") == 0).alias("accepted"), "reasons")
