"""Grids: row = supplier, column = part, frame = line number or return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids
from .registry import dealt, query, r, table


@query("block_mean_downsample", "SELECT l_linenumber, l_suppkey // 4 AS by, l_partkey // 16 AS bx, count(l_extendedprice) AS n, round(avg(l_extendedprice) + 1e-9, 4) AS mean FROM lineitem GROUP BY 1, 2, 3")
def block_mean_downsample(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"y": F.col("l_suppkey") / 4, "x": F.col("l_partkey") / 16})
    return grids.block_mean(rows, ["l_linenumber"], "y", "x", "l_extendedprice", 1).withColumn("mean", r("mean", 4))


@query(
    "tile_background",
    """WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.7) AS hi FROM lineitem GROUP BY 1)
    SELECT l_suppkey, count(*) AS n, round(median(l_extendedprice) + 1e-9, 4) AS background FROM lineitem JOIN q USING (l_suppkey) WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1""",
)
def tile_background(spark, sf_dir):
    return grids.tile_background(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice").withColumn("background", r("background", 4))


@query(
    "tile_offset",
    """WITH c AS (SELECT l_suppkey, l_partkey, avg(CASE WHEN l_linenumber <= 3 THEN l_extendedprice END) AS t, avg(CASE WHEN l_linenumber > 3 THEN l_extendedprice END) AS r FROM lineitem GROUP BY 1, 2),
    p AS (SELECT * FROM c WHERE t IS NOT NULL AND r IS NOT NULL),
    q AS (SELECT l_suppkey, quantile_cont(t, 0.05) AS t0, quantile_cont(t, 0.7) AS t1, quantile_cont(r, 0.05) AS r0, quantile_cont(r, 0.7) AS r1 FROM p GROUP BY 1),
    d AS (SELECT l_suppkey, t - r AS d FROM p JOIN q USING (l_suppkey) WHERE t BETWEEN t0 AND t1 AND r BETWEEN r0 AND r1),
    m AS (SELECT l_suppkey, median(d) AS med FROM d GROUP BY 1), s AS (SELECT l_suppkey, median(abs(d - med)) AS mad FROM d JOIN m USING (l_suppkey) GROUP BY 1),
    k AS (SELECT d.*, abs(d - med) <= 3.5 * 1.4826 * mad AS ok, count(*) FILTER (WHERE abs(d - med) <= 3.5 * 1.4826 * mad) OVER (PARTITION BY d.l_suppkey) AS n FROM d JOIN m USING (l_suppkey) JOIN s USING (l_suppkey)),
    u AS (SELECT l_suppkey, d FROM k WHERE ok OR n < 8), um AS (SELECT l_suppkey, median(d) AS med, count(*) AS n FROM u GROUP BY 1)
    SELECT l_suppkey, max(n) AS n, round(max(med) + 1e-9, 4) AS "offset", round(1.4826 * median(abs(d - med)) + 1e-9, 4) AS madn FROM u JOIN um USING (l_suppkey) GROUP BY 1""",
)
def tile_offset(spark, sf_dir):
    price = F.col("l_extendedprice")
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.avg(F.when(F.col("l_linenumber") <= 3, price)).alias("t"), F.avg(F.when(F.col("l_linenumber") > 3, price)).alias("r"))
    out = grids.tile_offset(cells, ["l_suppkey"], "t", "r")
    return out.select("l_suppkey", "n", r("offset", 4).alias("offset"), r("madn", 4).alias("madn"))


@query(
    "grid_consensus",
    """WITH g AS (SELECT l_linenumber AS frame, l_suppkey % 16 AS row, l_partkey % 16 AS col, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3),
    e AS (SELECT row, col, count(*) AS f, quantile_cont(v, 0.1) AS e FROM g GROUP BY 1, 2),
    d AS (SELECT frame, v - e AS d FROM g JOIN e USING (row, col) WHERE f >= 3), m AS (SELECT frame, median(d) AS med FROM d GROUP BY 1)
    SELECT frame, count(*) AS cells, round(CASE WHEN count(*) >= 16 THEN greatest(0, quantile_cont(d - med, 0.9)) END + 1e-9, 4) AS dimming, round(CASE WHEN count(*) >= 16 THEN greatest(0, quantile_cont(med - d, 0.9)) END + 1e-9, 4) AS brightening FROM d JOIN m USING (frame) GROUP BY 1""",
)
def grid_consensus(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_suppkey") % 16).alias("row"), (F.col("l_partkey") % 16).alias("col")).agg(F.avg("l_extendedprice").alias("v"))
    out = grids.consensus(cells, "frame", "row", "col", "v")
    return out.select("frame", "cells", r("dimming", 4).alias("dimming"), r("brightening", 4).alias("brightening"))


@query("common_coverage", "SELECT l_returnflag, l_linestatus, l_linenumber, count(DISTINCT l_suppkey) AS frames FROM lineitem GROUP BY 1, 2, 3 HAVING count(DISTINCT l_suppkey) >= ceil((SELECT count(DISTINCT l_suppkey) FROM lineitem) / 2.0)")
def common_coverage(spark, sf_dir):
    return grids.common_coverage(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "checkerboard_holdout",
    """WITH g AS (SELECT l_returnflag, l_suppkey % 32 AS y, l_partkey % 32 AS x, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3),
    f AS (SELECT l_returnflag, regr_count(v, x) AS c, avg(v) AS mz, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xz, covar_pop(y, v) AS yz FROM g WHERE (x + y) % 2 = 0 GROUP BY 1),
    b AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS kx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS ky FROM f)
    SELECT l_returnflag, count(*) AS n, round(sqrt(avg(pow(v - mz, 2))) + 1e-9, 3) AS rms_raw, round(sqrt(avg(pow(v - mz - kx * (x - mx) - ky * (y - my), 2))) + 1e-9, 3) AS rms_plane FROM g JOIN b USING (l_returnflag) WHERE (x + y) % 2 = 1 GROUP BY 1""",
)
def checkerboard_holdout(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_suppkey") % 32).alias("y"), (F.col("l_partkey") % 32).alias("x")).agg(F.avg("l_extendedprice").alias("v"))
    out = grids.checkerboard_holdout(cells, ["l_returnflag"], "y", "x", "v")
    return out.select("l_returnflag", "n", r("rms_raw", 3).alias("rms_raw"), r("rms_plane", 3).alias("rms_plane"))


@query(
    "blend_taper",
    """WITH s AS (SELECT l_partkey, l_extendedprice AS v, 1.0 + l_tax AS var, least(1.0, l_quantity / 25.0) AS t FROM lineitem), w AS (SELECT *, t * t * (3 - 2 * t) / var AS w FROM s)
    SELECT l_partkey, count(*) FILTER (WHERE w > 0) AS panels, round(sum(w * v) / sum(w) + 1e-9, 4) AS value, round(sqrt(sum(w * w * var)) / sum(w) + 1e-9, 8) AS noise FROM w GROUP BY 1""",
)
def blend_taper(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("var", 1.0 + F.col("l_tax")).withColumn("w", grids.taper(F.col("l_quantity"), 25.0) / F.col("var"))
    out = grids.blend(rows, ["l_partkey"], "l_extendedprice", "w", "var")
    return out.select("l_partkey", "panels", r("value", 4).alias("value"), r("noise", 8).alias("noise"))


@query(
    "drizzle_splat",
    """WITH p AS (SELECT p_brand, (p_size % 13) + (p_partkey % 7) / 7.0 AS x, (p_partkey % 11) + (p_size % 5) / 5.0 AS y, p_retailprice AS v, 1.0 AS w FROM part),
    c AS (SELECT p.*, a.i AS ox, b.i AS oy FROM p, range(-1, 16) a(i), range(-1, 16) b(i)),
    s AS (SELECT *, greatest(0, least(x + 0.35, ox + 0.5) - greatest(x - 0.35, ox - 0.5)) / 0.7 * greatest(0, least(y + 0.35, oy + 0.5) - greatest(y - 0.35, oy - 0.5)) / 0.7 AS a FROM c)
    SELECT p_brand, cast(oy AS INTEGER) AS oy, cast(ox AS INTEGER) AS ox, round(sum(a * w * v) / sum(a * w) + 1e-9, 4) AS value, round(sum(a * w) + 1e-9, 6) AS weight, round(sum(a) + 1e-9, 6) AS coverage FROM s WHERE a > 1e-12 GROUP BY 1, 2, 3""",
)
def drizzle_splat(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 13 + F.col("p_partkey") % 7 / 7.0).alias("x"), (F.col("p_partkey") % 11 + F.col("p_size") % 5 / 5.0).alias("y"), F.col("p_retailprice").alias("v"), F.lit(1.0).alias("w"))
    out = grids.splat(p, ["p_brand"], "x", "y", "v", "w", 0.7)
    return out.where("coverage > 1e-9").select("p_brand", "oy", "ox", r("value", 4).alias("value"), r("weight").alias("weight"), r("coverage").alias("coverage"))


@query(
    "valid_run",
    """WITH v AS (SELECT l_suppkey, l_partkey AS x FROM lineitem GROUP BY 1, 2 HAVING avg(l_discount) >= 0.03), g AS (SELECT *, x - row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS run FROM v),
    r AS (SELECT l_suppkey, min(x) AS first, max(x) AS last FROM g GROUP BY l_suppkey, run)
    SELECT l_suppkey, first, last FROM r QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY first - last, first) = 1""",
)
def valid_run(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    # Dealt once, by the key of the runs: cells and runs then need no further shuffle.
    rows = dealt(lines.select("l_suppkey", F.col("l_partkey").alias("x"), "l_discount"), lines.count(), "l_suppkey")
    cells = rows.groupBy("l_suppkey", "x").agg(F.avg("l_discount").alias("d"))
    return grids.valid_run(cells, ["l_suppkey"], "x", F.col("d") >= 0.03)


@query("common_crop", "SELECT l_suppkey, CASE WHEN min(x1) > max(x0) AND min(y1) > max(y0) THEN max(x0) END AS x0, CASE WHEN min(x1) > max(x0) AND min(y1) > max(y0) THEN max(y0) END AS y0, CASE WHEN min(x1) > max(x0) AND min(y1) > max(y0) THEN min(x1) END AS x1, CASE WHEN min(x1) > max(x0) AND min(y1) > max(y0) THEN min(y1) END AS y1 FROM (SELECT l_suppkey, l_linenumber AS x0, 10 + l_linenumber AS x1, l_discount AS y0, 1 - l_tax AS y1 FROM lineitem) GROUP BY 1")
def common_crop(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("x0"), (10 + F.col("l_linenumber")).alias("x1"), F.col("l_discount").alias("y0"), (1 - F.col("l_tax")).alias("y1"))
    return grids.common_crop(rows, ["l_suppkey"])


@query(
    "trail_corridor",
    """WITH t AS (SELECT l_linenumber, avg(l_discount) * 20 AS angle, 10.0 AS distance, -40.0 AS start, 40.0 AS stop, 3.0 AS half_width FROM lineitem GROUP BY 1)
    SELECT DISTINCT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_suppkey % 50 * 1.0 AS y FROM lineitem) p JOIN t USING (l_linenumber)
    WHERE abs(cos(angle) * x + sin(angle) * y - distance) <= half_width AND -sin(angle) * x + cos(angle) * y BETWEEN start AND stop""",
)
def trail_corridor(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    trails = rows.groupBy("l_linenumber").agg((F.avg("l_discount") * 20).alias("angle")).withColumns({"distance": F.lit(10.0), "start": F.lit(-40.0), "stop": F.lit(40.0), "half_width": F.lit(3.0)})
    pixels = rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_suppkey") % 50 * 1.0).alias("y"))
    return grids.inside_corridor(pixels, trails, ["l_linenumber"], "x", "y").select("l_orderkey", "l_linenumber").distinct()
