"""Measures of sources and stacks over the line items and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import photometry, registration
from .registry import query, r, table


def _e(i):
    return F.get("embedding", F.lit(i)).cast("double")


@query(
    "background_flatness",
    """WITH c AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.7) AS c FROM lineitem GROUP BY 1)
    SELECT l_suppkey, count(*) AS n, round(quantile_cont(l_extendedprice, 0.95) - quantile_cont(l_extendedprice, 0.05) + 1e-9, 4) AS flatness FROM lineitem JOIN c USING (l_suppkey) WHERE l_extendedprice <= c GROUP BY 1""",
)
def background_flatness(spark, sf_dir):
    return photometry.flatness(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice").withColumn("flatness", r("flatness", 4))


def _pass(i, source):
    return f""", m{i} AS (SELECT k, median(v) AS m FROM {source} GROUP BY 1), s{i} AS (SELECT k, 1.4826 * median(abs(v - m)) AS s FROM {source} JOIN m{i} USING (k) GROUP BY 1),
    p{i} AS (SELECT a.k, a.v FROM {source} a JOIN m{i} USING (k) JOIN s{i} USING (k) WHERE s = 0 OR abs(v - m) <= 4.0 * s)"""


@query(
    "robust_ratio",
    "WITH r AS (SELECT l_suppkey AS k, l_extendedprice / (l_quantity * 1000) AS v FROM lineitem), m AS (SELECT k, median(v) AS m FROM r GROUP BY 1), p0 AS (SELECT r.k, v FROM r JOIN m USING (k) WHERE v BETWEEN 0.5 * m AND 2 * m)"
    + _pass(1, "p0") + _pass(2, "p1") + _pass(3, "p2")
    + " SELECT k AS l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 16 THEN median(v) END + 1e-9, 6) AS ratio FROM p3 GROUP BY 1",
)
def robust_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") / (F.col("l_quantity") * 1000))
    return photometry.robust_ratio(rows, ["l_suppkey"], "v").withColumn("ratio", r("ratio"))


@query(
    "half_flux_radius",
    """WITH f AS (SELECT l_suppkey, l_quantity AS rad, sum(l_extendedprice) AS f FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, sum(f) OVER (PARTITION BY l_suppkey ORDER BY rad) AS c, sum(f) OVER (PARTITION BY l_suppkey) AS t, coalesce(lag(rad) OVER (PARTITION BY l_suppkey ORDER BY rad), 0) AS p FROM f)
    SELECT l_suppkey, round(total, 2) AS total, round(radius + 1e-9, 6) AS radius FROM (SELECT l_suppkey, t AS total, p + (rad - p) * (0.5 * t - (c - f)) / f AS radius, row_number() OVER (PARTITION BY l_suppkey ORDER BY rad) AS k FROM c WHERE c >= 0.5 * t) WHERE k = 1""",
)
def half_flux_radius(spark, sf_dir):
    out = photometry.half_flux_radius(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", F.round("total", 2).alias("total"), r("radius").alias("radius"))


@query(
    "dither_phases",
    """WITH p AS (SELECT label, cast(embedding[1] AS DOUBLE) * 10 AS x, cast(embedding[2] AS DOUBLE) * 10 AS y FROM embeddings)
    SELECT label, count(*) AS frames, count(DISTINCT floor((x - floor(x)) * 4 + 0.5) % 4 * 10 + floor((y - floor(y)) * 4 + 0.5) % 4) AS phases FROM p GROUP BY 1""",
)
def dither_phases(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", (_e(0) * 10).alias("x"), (_e(1) * 10).alias("y"))
    return photometry.dither_phases(rows, ["label"], "x", "y")


@query(
    "tolerance_gate",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount = l_tax) AS equal, round(count(*) FILTER (WHERE abs(l_discount - l_tax) <= 0.1 * 0.05) / count(*)::DOUBLE + 1e-9, 6) AS bulk_share,
    round(count(*) FILTER (WHERE abs(l_discount - l_tax) > 0.05) / count(*)::DOUBLE + 1e-9, 6) AS outlier_share FROM lineitem GROUP BY 1""",
)
def tolerance_gate(spark, sf_dir):
    out = photometry.tolerance_gate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_tax", F.lit(0.05))
    return out.select("l_returnflag", "n", "equal", r("bulk_share").alias("bulk_share"), r("outlier_share").alias("outlier_share"))


@query(
    "airmass_envelope",
    """WITH e AS (SELECT user_id, event_id, 1 + event_id % 7 / 4.0 AS x, value / 50 AS y FROM events), s AS (SELECT user_id, count(*) AS n, max(x) - min(x) AS span FROM e GROUP BY 1),
    p AS (SELECT a.user_id, (b.y - a.y) / (b.x - a.x) AS s FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.x <> b.x), f AS (SELECT user_id, greatest(least(median(s), 3.0), -0.05) AS slope FROM p GROUP BY 1),
    d AS (SELECT event_id, e.user_id, n, y - CASE WHEN span < 0.15 THEN 0 ELSE coalesce(slope, 0) END * x AS e FROM e JOIN s USING (user_id) LEFT JOIN f USING (user_id))
    SELECT event_id, round(CASE WHEN n >= 4 THEN e - quantile_cont(e, 0.05) OVER (PARTITION BY user_id) END + 1e-9, 6) AS excess FROM d""",
)
def airmass_envelope(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({"x": 1 + F.col("event_id") % 7 / 4.0, "y": F.col("value") / 50})
    return photometry.airmass_envelope(rows, ["user_id"], "x", "y", "event_id").select("event_id", r("excess").alias("excess"))


@query(
    "triangles",
    """WITH p AS (SELECT vec_id AS id, label, cast(embedding[1] AS DOUBLE) AS x, cast(embedding[2] AS DOUBLE) AS y, row_number() OVER (PARTITION BY label ORDER BY cast(embedding[3] AS DOUBLE) DESC, vec_id) AS k FROM embeddings), q AS (SELECT * FROM p WHERE k <= 8),
    t AS (SELECT a.label, a.id AS a, b.id AS b, c.id AS c, list_sort([sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2)), sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2))]) AS s FROM q a JOIN q b ON a.label = b.label AND a.id < b.id JOIN q c ON b.label = c.label AND b.id < c.id)
    SELECT label, a, b, c, round(s[3] / s[2] + 1e-9, 6) AS r1, round(s[3] / s[1] + 1e-9, 4) AS r2 FROM t""",
)
def triangles(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", _e(0).alias("x"), _e(1).alias("y"), _e(2).alias("z"))
    out = photometry.triangles(rows, ["label"], "vec_id", "x", "y", "z", 8)
    return out.select("label", "a", "b", "c", r("r1").alias("r1"), r("r2", 4).alias("r2"))


@query(
    "background_shape",
    """WITH c AS (SELECT l_returnflag AS g, l_linenumber AS f, l_suppkey % 16 AS y, l_partkey % 16 AS x, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
    m AS (SELECT g, f, median(v) AS m FROM c GROUP BY 1, 2), d AS (SELECT g, f, y, x, v - m AS v FROM c JOIN m USING (g, f)), k AS (SELECT g, y, x, median(v) AS k FROM d GROUP BY 1, 2, 3)
    SELECT g, f, round(quantile_cont(v - k, 0.95) - quantile_cont(v - k, 0.05) + 1e-9, 4) AS shape FROM d JOIN k USING (g, y, x) WHERE NOT (y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11) GROUP BY 1, 2""",
)
def background_shape(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("f"), (F.col("l_suppkey") % 16).alias("y"), (F.col("l_partkey") % 16).alias("x")).agg(F.avg("l_extendedprice").alias("v"))
    return photometry.background_shape(cells, ["g"], "f", "y", "x", "v").withColumn("shape", r("shape", 4))


@query(
    "histogram_lines",
    """WITH b AS (SELECT p_partkey, p_brand, floor(p_retailprice / 25) AS bin FROM part), c AS (SELECT p_brand, bin, count(*) AS c FROM b GROUP BY 1, 2), m AS (SELECT *, avg(c) OVER (PARTITION BY p_brand) AS m FROM c)
    SELECT p_partkey FROM b JOIN m USING (p_brand, bin) WHERE c <= m + 2.0 * sqrt(m)""",
)
def histogram_lines(spark, sf_dir):
    return photometry.histogram_lines(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 25.0, 2.0).select("p_partkey")


@query(
    "uniform_thinning",
    """WITH t AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand, floor(p_size / 10.0) , floor(p_partkey / 100.0) ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part)
    SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY turn, p_retailprice DESC, p_partkey) AS place FROM t) WHERE place <= 5""",
)
def uniform_thinning(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"x": F.col("p_size") / 10.0, "y": F.col("p_partkey") / 100.0})
    return photometry.thinned(rows, ["p_brand"], "x", "y", 1.0, "p_retailprice", "p_partkey", 5).select("p_brand", "p_partkey")


@query(
    "register_similarity",
    """WITH s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), m AS (SELECT label, 0.9 + 0.02 * (label % 10) AS scale, 0.3 * label AS angle FROM (SELECT DISTINCT label FROM embeddings))
    SELECT label, count(*) AS source_count, count(*) FILTER (WHERE vec_id % 7 <> 0) AS reference_count, round(scale * cos(angle) + 1e-9, 5) AS a, round(scale * sin(angle) + 1e-9, 5) AS b, round(10.0 * label + 3.25 + 1e-9, 3) AS tx, round(40 - 7.5 * label + 1e-9, 3) AS ty,
    count(*) FILTER (WHERE vec_id % 7 <> 0) AS inliers, count(*) FILTER (WHERE vec_id % 7 <> 0) >= 12 AS accepted FROM s JOIN m USING (label) GROUP BY label, scale, angle""",
)
def register_similarity(spark, sf_dir):
    """Each label's points against those of them that a known similarity has moved; the SQL states that similarity, not a search."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", "label", (_e(0) * 20000).alias("x"), (_e(1) * 20000).alias("y"), _e(2).alias("z"))
    scale, angle = 0.9 + 0.02 * (F.col("label") % 10), 0.3 * F.col("label")
    a, b = scale * F.cos(angle), scale * F.sin(angle)
    x = a * F.col("x") - b * F.col("y") + 10.0 * F.col("label") + 3.25
    y = b * F.col("x") + a * F.col("y") + 40 - 7.5 * F.col("label")
    t = s.where("vec_id % 7 <> 0").select("vec_id", "label", x.alias("x"), y.alias("y"), "z")
    out = registration.register(s, t, ["label"], "vec_id", "x", "y", "z")
    return out.select("label", "source_count", "reference_count", r("a", 5).alias("a"), r("b", 5).alias("b"), r("tx", 3).alias("tx"), r("ty", 3).alias("ty"), "inliers", "accepted")
