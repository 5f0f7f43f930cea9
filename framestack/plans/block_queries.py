"""Blocks and polygons: image = return flag, row = supplier, column = part."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import blocks, joins, photometry, polygons
from .registry import dealt, query, r, table, tasks

ROWS, SIDE = 24, 64
TILT = 0.0002
MATRIX = [math.cos(TILT), -math.sin(TILT), 2.3, math.sin(TILT), math.cos(TILT), 0.7, 0.0, 0.0, 1.0]

IMAGE = f"""WITH RECURSIVE v AS (SELECT l_returnflag AS f, l_suppkey % {ROWS} AS y, l_partkey AS x, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT max(l_partkey) + 1 AS w FROM lineitem), fl AS (SELECT DISTINCT f FROM v),
g AS (SELECT f, y.y, x.x FROM fl, range({ROWS}) y(y), (SELECT unnest(range(w)) AS x FROM w) x),
p AS (SELECT g.f, g.y, g.x, coalesce(v.v, 0) AS v FROM g LEFT JOIN v ON g.f = v.f AND g.y = v.y AND g.x = v.x)
"""


def _images(spark, sf_dir, matrix=None):
    """(images, blocks, width): a row an image, and all their pixels in blocks; those without a line are 0."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), (F.col("l_suppkey") % ROWS).alias("y"), F.col("l_partkey").alias("x"), F.col("l_discount").alias("v"))
    width = int(rows.agg(F.max("x")).first()[0] or 0) + 1
    m = F.array(*[F.lit(v) for v in matrix]) if matrix else F.lit(None).cast("array<double>")
    one = lambda v: F.lit(v).cast("int")
    # The images are written out, as they are read again for blocks and windows.
    images = joins.cut(rows.select("f").distinct()).select("f", one(ROWS).alias("height"), one(width).alias("width"), one(ROWS).alias("out_height"), one(width).alias("out_width"), m.alias("m"))
    return images, blocks.from_sparse(rows, images, ["f"], "y", "x", "v", SIDE), width


@query(
    "lanczos_warp",
    IMAGE
    + f""", s AS (SELECT f, y, x, {MATRIX[0]!r}::DOUBLE * x + {MATRIX[1]!r}::DOUBLE * y + {MATRIX[2]!r}::DOUBLE AS sx, {MATRIX[3]!r}::DOUBLE * x + {MATRIX[4]!r}::DOUBLE * y + {MATRIX[5]!r}::DOUBLE AS sy FROM p),
    i AS (SELECT * FROM s, w WHERE sx BETWEEN 2 AND w - 3 AND sy BETWEEN 2 AND {ROWS - 3}),
    k AS (SELECT i.*, a.i AS i, b.j AS j, sx - floor(sx) - a.i AS tx, sy - floor(sy) - b.j AS ty FROM i, range(-2, 4) a(i), range(-2, 4) b(j)),
    q AS (SELECT f, y, x, cast(floor(sx) AS BIGINT) + i AS px, cast(floor(sy) AS BIGINT) + j AS py, CASE WHEN tx = 0 THEN 1 ELSE 3 * sin(pi() * tx) * sin(pi() * tx / 3) / (pi() * pi() * tx * tx) END * CASE WHEN ty = 0 THEN 1 ELSE 3 * sin(pi() * ty) * sin(pi() * ty / 3) / (pi() * pi() * ty * ty) END AS c FROM k)
    SELECT q.f, q.y, q.x, round(least(max(p.v), greatest(min(p.v), sum(c * p.v) / sum(c))) + 1e-9, 6) AS value FROM q JOIN p ON p.f = q.f AND p.y = q.py AND p.x = q.px GROUP BY 1, 2, 3""",
)
def lanczos_warp(spark, sf_dir):
    images, held, _ = _images(spark, sf_dir, MATRIX)
    out = blocks.warp(held, blocks.matrix_windows(images, ["f"], SIDE), ["f"], SIDE)
    return blocks.to_pixels(out, ["f"], SIDE).select("f", "y", "x", r("value").alias("value"))


@query(
    "lattice_warp",
    IMAGE
    + f""", c AS (SELECT f, y, x, y // 8 AS cy, x // 8 AS cx, y % 8 / 8.0 AS fy, x % 8 / 8.0 AS fx FROM p),
    n AS (SELECT *, {{0}} FROM c), s AS (SELECT f, y, x, (x00 + fx * (x01 - x00)) + fy * ((x10 + fx * (x11 - x10)) - (x00 + fx * (x01 - x00))) AS sx, (y00 + fx * (y01 - y00)) + fy * ((y10 + fx * (y11 - y10)) - (y00 + fx * (y01 - y00))) AS sy FROM n),
    i AS (SELECT s.*, cast(floor(sx) AS BIGINT) AS ix, cast(floor(sy) AS BIGINT) AS iy FROM s, w WHERE sx BETWEEN 0 AND w - 1 AND sy BETWEEN 0 AND {ROWS - 1}),
    q AS (SELECT i.*, a.a, b.b, CASE WHEN a = 0 THEN 1 - (sx - ix) ELSE sx - ix END * CASE WHEN b = 0 THEN 1 - (sy - iy) ELSE sy - iy END AS c FROM i, range(2) a(a), range(2) b(b))
    SELECT q.f, q.y, q.x, round(sum(c * p.v) + 1e-9, 6) AS value FROM q JOIN p ON p.f = q.f AND p.y = q.iy + b AND p.x = q.ix + a WHERE c <> 0 GROUP BY 1, 2, 3""".format(
        ", ".join(f"(cx + {b}) * 8 + 0.5 + ((cx + {b}) * 7 + (cy + {a}) * 3) % 4 * 0.25 AS x{a}{b}, (cy + {a}) * 8 + 0.25 + ((cx + {b}) + (cy + {a}) * 2) % 4 * 0.125 AS y{a}{b}" for a in (0, 1) for b in (0, 1))
    ),
)
def lattice_warp(spark, sf_dir):
    images, held, width = _images(spark, sf_dir)
    last = lambda n: -(-n // 8)
    ny, nx = F.col("ny"), F.col("nx")
    # Nodes of a row are made by thousands in many tasks: the images are few rows.
    some = images.select("f", F.explode(F.sequence(F.lit(0), F.lit(last(ROWS)))).alias("ny")).withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(last(width) // 4096))))
    some = dealt(some, (last(ROWS) + 1) * (last(width) + 1), "f", "ny", "_n")
    nodes = some.select("f", "ny", F.explode(F.sequence(F.col("_n") * 4096, F.least(F.col("_n") * 4096 + 4095, F.lit(last(width))))).alias("nx"))
    nodes = nodes.withColumns({"sx": nx * 8 + 0.5 + (nx * 7 + ny * 3) % 4 * 0.25, "sy": ny * 8 + 0.25 + (nx + ny * 2) % 4 * 0.125})
    out = blocks.warp(held, blocks.lattice_windows(images, nodes, ["f"], 8, SIDE), ["f"], SIDE, linear=True, spacing=8)
    return blocks.to_pixels(out, ["f"], SIDE).select("f", "y", "x", r("value").alias("value"))


@query(
    "region_labels",
    """WITH RECURSIVE p AS (SELECT l_returnflag AS f, l_suppkey AS y, l_partkey AS x, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3 HAVING max(l_quantity) > 15),
    s AS (SELECT f, y, x FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.f = p.f AND q.y = p.y AND q.x = p.x - 1) AND NOT EXISTS (SELECT 1 FROM p q WHERE q.f = p.f AND q.y = p.y - 1 AND q.x = p.x)),
    d AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(a, b)),
    t AS (SELECT f, y * 2147483648 + x AS label, y, x FROM s UNION SELECT t.f, t.label, p.y, p.x FROM t, d, p WHERE p.f = t.f AND p.y = t.y + a AND p.x = t.x + b),
    m AS (SELECT f, y, x, min(label) AS label FROM t GROUP BY 1, 2, 3)
    SELECT m.f, m.label // 2147483648 AS y, m.label % 2147483648 AS x, count(*) AS n, min(m.y) AS y0, min(m.x) AS x0, max(m.y) AS y1, max(m.x) AS x1, round(sum(v) + 1e-9, 4) AS total, max(v) * 1.0::DOUBLE AS peak FROM m JOIN p ON p.f = m.f AND p.y = m.y AND p.x = m.x GROUP BY m.f, m.label""",
)
def region_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "f")
    parts = blocks.label_points(lines, ["f"], "l_suppkey", "l_partkey", "l_quantity", 15.0, SIDE, tasks=tasks(spark, lines.count()))
    joined = blocks.joined_parts(parts, ["f"])
    return blocks.regions(joined, ["f"]).drop("label").withColumn("total", r("total", 4))


RADII = (2.2011, 3.5011, 5.5011)
FLUX = (
    IMAGE
    + f""", t AS (SELECT p_partkey AS star, p_partkey + p_size % 10 / 10.0 AS sx, 12 + (p_partkey % 7 - 3) / 2.0 AS sy FROM part),
    d AS (SELECT p.f, star, v, pow(p.x - sx, 2) + pow(p.y - sy, 2) AS d FROM t JOIN p ON p.x BETWEEN p_floor(sx) - 6 AND p_floor(sx) + 7),
    a AS (SELECT f, star, count(*) FILTER (WHERE d < {RADII[0] ** 2!r}) AS n, sum(v) FILTER (WHERE d < {RADII[0] ** 2!r}) AS s, avg(v) FILTER (WHERE d >= {RADII[1] ** 2!r} AND d < {RADII[2] ** 2!r}) AS b FROM d GROUP BY 1, 2),
    k AS (SELECT star, count(*) AS need FROM t, range(-3, 5) i(i), range(-3, 5) j(j) WHERE pow(sx - floor(sx) - i, 2) + pow(sy - floor(sy) - j, 2) < {RADII[0] ** 2!r} GROUP BY 1),
    u AS (SELECT fl.f, k.star, coalesce(n, 0) AS n, b, CASE WHEN n = need THEN s - n * b END AS flux FROM fl, k LEFT JOIN a ON a.f = fl.f AND a.star = k.star)
"""
).replace("p_floor(sx)", "cast(floor(sx) AS BIGINT)")


def _fluxes(spark, sf_dir):
    images, held, _ = _images(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    at = part.select(F.col("p_partkey").alias("star"), (F.col("p_partkey") + F.col("p_size") % 10 / 10.0).alias("x"), (12 + (F.col("p_partkey") % 7 - 3) / 2.0).alias("y"))
    # Three images at most: the flags.
    flags = [F.lit(row[0]) for row in images.select("f").orderBy("f").limit(100).collect()]
    stars = at.withColumn("f", F.explode(F.array(*flags)))
    return blocks.apertures(stars, held, ["f"], "star", "x", "y", *RADII, SIDE)


@query("aperture_flux", FLUX + "SELECT f, star, n, round(b + 1e-9, 6) AS background, round(flux + 1e-9, 6) AS flux FROM u")
def aperture_flux(spark, sf_dir):
    return _fluxes(spark, sf_dir).select("f", "star", "n", r("background").alias("background"), r("flux").alias("flux"))


def _clip(n: int) -> str:
    a = "abc"[n]
    return f"""m{a} AS (SELECT *, median(v) OVER (PARTITION BY f) AS m FROM r{n}), s{a} AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY f) AS s FROM m{a}),
    k{a} AS (SELECT *, count(*) FILTER (WHERE abs(v - m) <= 4 * s) OVER (PARTITION BY f) AS kept FROM s{a}), r{n + 1} AS (SELECT f, v FROM k{a} WHERE abs(v - m) <= 4 * s OR s <= 2.220446049250313e-16 OR kept < 16)"""


@query(
    "stellar_throughput",
    FLUX
    + f""", e AS (SELECT f, CASE f WHEN 'R' THEN 60.0 ELSE 30.0 END AS e FROM fl), z AS (SELECT a.f, b.flux / a.flux * e / 30.0 AS v FROM u a JOIN u b ON a.star = b.star AND b.f = 'N' JOIN e ON e.f = a.f WHERE a.flux > 0 AND b.flux > 0),
    c AS (SELECT f, count(*) AS pairs FROM z GROUP BY 1), r00 AS (SELECT z.f, v, median(v) OVER (PARTITION BY z.f) AS m FROM z JOIN c ON c.f = z.f WHERE pairs >= 16), r0 AS (SELECT f, v FROM r00 WHERE v BETWEEN 0.5 * m AND 2 * m),
    {_clip(0)}, {_clip(1)}, {_clip(2)}, mm AS (SELECT *, median(v) OVER (PARTITION BY f) AS m FROM r3), o AS (SELECT f, count(*) AS n, max(m) AS scale, 1.4826 * median(abs(v - m)) AS sigma FROM mm GROUP BY 1)
    SELECT fl.f, CASE WHEN fl.f = 'N' THEN 1.0 WHEN n >= 16 THEN round(scale + 1e-9, 5) END AS scale, CASE WHEN fl.f = 'N' THEN 0.0 WHEN n >= 16 THEN round(sigma + 1e-9, 5) END AS sigma, CASE WHEN fl.f <> 'N' AND n >= 16 THEN n END AS stars,
      CASE WHEN fl.f = 'N' THEN 'REFERENCE_IDENTITY' WHEN n >= 16 THEN 'STELLAR_SCALE_ACCEPTED' ELSE 'STELLAR_SCALE_UNAVAILABLE' END AS status FROM fl LEFT JOIN o ON o.f = fl.f""",
)
def stellar_throughput(spark, sf_dir):
    flux = joins.cut(_fluxes(spark, sf_dir).withColumn("_", F.lit(1)).select("f", "star", "flux"))
    pairs = flux.join(flux.where("f = 'N'").select("star", F.col("flux").alias("reference_flux")).hint("merge"), "star").drop("star")
    frames = flux.select("f").distinct().select("f", F.lit("N").alias("reference"), F.when(F.col("f") == "R", 60.0).otherwise(30.0).alias("exposure"))
    out = photometry.throughput(frames, pairs, [], "f")
    return out.select("f", r("scale", 5).alias("scale"), r("sigma", 5).alias("sigma"), "stars", "status")


@query(
    "frame_quality",
    """WITH s AS (SELECT l_suppkey % 3 AS filter, l_suppkey AS frame, count(*) AS stars, median(1 + l_discount * 10) AS fwhm, sum(l_quantity) AS p, sum(l_extendedprice) AS f FROM lineitem GROUP BY 1, 2),
    q AS (SELECT filter, frame, stars, fwhm, least(stars, 500) / greatest(fwhm * fwhm, 0.25) AS quality, p * fwhm * fwhm / (f * stars) AS native FROM s)
    SELECT filter, frame, stars, round(fwhm + 1e-9, 6) AS fwhm, round(quality + 1e-9, 6) AS quality, round(native * 1e6 + 1e-9, 6) AS native, round(native / median(native) OVER (PARTITION BY filter) + 1e-9, 6) AS weight FROM q""",
)
def frame_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("filter"), F.col("l_suppkey").alias("frame"), (1 + F.col("l_discount") * 10).alias("w"), "l_quantity", "l_extendedprice")
    out = photometry.frame_quality(rows, ["filter"], "frame", "w", "l_quantity", "l_extendedprice")
    return out.select("filter", "frame", "stars", r("fwhm").alias("fwhm"), r("quality").alias("quality"), r(F.col("native") * 1e6).alias("native"), r("weight").alias("weight"))


SHAPES = """WITH RECURSIVE c AS (SELECT p_brand AS g, p_partkey AS id, p_partkey * 37 % 997 / 10.0 AS cx, p_size * 2.0 + p_partkey % 17 / 10.0 AS cy, 1 + p_partkey % 4 AS w, 1 + p_partkey % 3 AS h, p_partkey % 31 / 10.0 AS t FROM part),
k AS (SELECT * FROM (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) k(i, a, b)),
v AS (SELECT g, id, i, cx + a * w * cos(t) - b * h * sin(t) AS x, cy + a * w * sin(t) + b * h * cos(t) AS y FROM c, k),
e AS (SELECT p.g, p.id, p.i, p.x, p.y, q.x AS x2, q.y AS y2 FROM v p JOIN v q ON p.id = q.id AND q.i = (p.i + 1) % 4),
bx AS (SELECT g, id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY 1, 2),
pr AS (SELECT a.g, a.id AS a, b.id AS b FROM bx a JOIN bx b ON a.g = b.g AND a.id < b.id WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
ib AS (SELECT pr.a, pr.b, v.x, v.y FROM pr JOIN v ON v.id = pr.a JOIN e ON e.id = pr.b GROUP BY 1, 2, 3, 4 HAVING min((e.x2 - e.x) * (v.y - e.y) - (e.y2 - e.y) * (v.x - e.x)) >= 0),
ia AS (SELECT pr.a, pr.b, v.x, v.y FROM pr JOIN v ON v.id = pr.b JOIN e ON e.id = pr.a GROUP BY 1, 2, 3, 4 HAVING min((e.x2 - e.x) * (v.y - e.y) - (e.y2 - e.y) * (v.x - e.x)) >= 0),
ee AS (SELECT pr.a, pr.b, m.x, m.y, m.x2 - m.x AS dx, m.y2 - m.y AS dy, n.x - m.x AS ox, n.y - m.y AS oy, n.x2 - n.x AS ex, n.y2 - n.y AS ey FROM pr JOIN e m ON m.id = pr.a JOIN e n ON n.id = pr.b),
cr AS (SELECT a, b, x + dx * t AS x, y + dy * t AS y FROM (SELECT *, (ox * ey - oy * ex) / (dx * ey - dy * ex) AS t, (ox * dy - oy * dx) / (dx * ey - dy * ex) AS u FROM ee WHERE abs(dx * ey - dy * ex) > 1e-12) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
pt AS (SELECT * FROM ib UNION ALL SELECT * FROM ia UNION ALL SELECT * FROM cr), ct AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM pt WINDOW w AS (PARTITION BY a, b)),
rg AS (SELECT a, b, x - mx AS x, y - my AS y, row_number() OVER w AS k, count(*) OVER (PARTITION BY a, b) AS n FROM ct WINDOW w AS (PARTITION BY a, b ORDER BY atan2(y - my, x - mx))),
ar AS (SELECT p.a, p.b, sum(p.x * q.y - q.x * p.y) / 2 AS area FROM rg p JOIN rg q ON p.a = q.a AND p.b = q.b AND q.k = p.k % p.n + 1 GROUP BY 1, 2),
ov AS (SELECT a, b, area FROM ar WHERE area > 0.0005)
"""


def _overlaps(spark, sf_dir, spanning=False):
    n = F.col("p_partkey")
    x, y, w, h, t = n * 37 % 997 / 10.0, F.col("p_size") * 2.0 + n % 17 / 10.0, 1 + n % 4, 1 + n % 3, n % 31 / 10.0
    corner = lambda a, b: F.struct((x + a * w * F.cos(t) - b * h * F.sin(t)).alias("x"), (y + a * w * F.sin(t) + b * h * F.cos(t)).alias("y"))
    shapes = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("shape"))
    return polygons.overlapping(shapes, ["p_brand"], "p_partkey", "shape", 8.0, 0.0005, spanning)


@query("polygon_overlap", SHAPES + "SELECT a, b, round(area + 1e-9, 5) AS area FROM ov")
def polygon_overlap(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("a", "b", r("area", 5).alias("area"))


@query(
    "panels_connected",
    SHAPES + """, l AS (SELECT a AS u, b AS v FROM ov UNION SELECT b, a FROM ov), c2 AS (SELECT DISTINCT u AS node, u AS seen FROM l UNION SELECT c2.node, l.v FROM c2 JOIN l ON l.u = c2.seen)
    SELECT node, min(seen) AS component FROM c2 GROUP BY 1""",
)
def panels_connected(spark, sf_dir):
    return joins.components(_overlaps(spark, sf_dir, spanning=True), "a", "b")
