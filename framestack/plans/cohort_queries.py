"""Frames against their reference and group, over parts, suppliers, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, grids, scores
from .registry import query, r, table


@query(
    "frame_completeness",
    """WITH p AS (SELECT p_brand, (p_partkey % 97)::DOUBLE AS x, p_size * 2.0 AS y, p_retailprice AS flux, p_size + 0.5 AS ref, p_partkey FROM part),
    u AS (SELECT *, (0.9 * (x - 5.25) + 0.1 * (y + 3.1)) / 0.82 AS u, (0.9 * (y + 3.1) - 0.1 * (x - 5.25)) / 0.82 AS v FROM p),
    w AS (SELECT p_brand, count(*) FILTER (WHERE u >= 0 AND u < 90 AND v >= 0 AND v < 95) AS expected FROM u GROUP BY 1),
    i AS (SELECT p_brand, flux / ref AS r, floor(y / 95 * 16) * 16 + floor(x / 90 * 16) AS cell FROM p WHERE p_partkey % 3 = 0 AND x < 90 AND y < 95),
    g AS (SELECT p_brand, count(*) AS matched, median(r) AS g FROM i GROUP BY 1), e AS (SELECT p_brand, cell, -2.5 * log10(r / g) AS e FROM i JOIN g USING (p_brand)),
    s AS (SELECT p_brand, median(abs(e)) AS spread FROM e GROUP BY 1), c AS (SELECT p_brand, cell, median(e) AS m FROM e GROUP BY 1, 2 HAVING count(*) >= 3), k AS (SELECT p_brand, CASE WHEN count(*) >= 16 THEN quantile_cont(abs(m), 0.9) END AS p90 FROM c GROUP BY 1)
    SELECT p_brand, expected, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / nullif(expected, 0)::DOUBLE + 1e-9, 6) AS completeness, round(g + 1e-9, 4) AS transparency, round(spread + 1e-9, 6) AS spread, round(p90 + 1e-9, 6) AS spatial_p90 FROM w LEFT JOIN g USING (p_brand) LEFT JOIN s USING (p_brand) LEFT JOIN k USING (p_brand)""",
)
def frame_completeness(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 97).cast("double").alias("x"), (F.col("p_size") * 2.0).alias("y"), F.col("p_retailprice").alias("flux"), (F.col("p_size") + 0.5).alias("reference_flux"))
    size = {"width": F.lit(90.0), "height": F.lit(95.0)}
    expected = p.withColumns(size | {"a": F.lit(0.9), "b": F.lit(0.1), "tx": F.lit(5.25), "ty": F.lit(-3.1)})
    matches = p.where("p_partkey % 3 = 0").withColumn("cell", cohort.cell_of(F.col("x"), F.col("y"), size["width"], size["height"]))
    out = cohort.completeness(expected, matches, ["p_brand"])
    return out.select("p_brand", "expected", "matched", r("completeness").alias("completeness"), r("transparency", 4).alias("transparency"), r("spread").alias("spread"), r("spatial_p90").alias("spatial_p90"))


@query(
    "normalisation_reference",
    """WITH a AS (SELECT *, s_suppkey % 3 <> 0 AS ok, max(s_suppkey % 3 <> 0) OVER (PARTITION BY s_nationkey) AS any_ok FROM supplier),
    q AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM a WHERE ok OR NOT any_ok),
    b AS (SELECT s_nationkey, s_suppkey, s_suppkey % 13 + 0.02 * (s_suppkey % 7) AS score FROM q WHERE k <= greatest(1, ceil(0.75 * n))),
    o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score, s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS considered FROM b)
    SELECT s_nationkey, s_suppkey AS reference, round(score + 1e-9, 6)::DOUBLE AS score, considered FROM o WHERE k = 1""",
)
def normalisation_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumns({"span": F.col("s_suppkey") % 13, "sky": F.col("s_suppkey") % 7})
    return cohort.normalisation_reference(rows, ["s_nationkey"], "s_suppkey", "s_acctbal", "span", "sky", F.col("s_suppkey") % 3 != 0).withColumn("score", r("score"))


@query(
    "suspect_channels",
    """WITH c AS (SELECT o_custkey, count(*) AS frames, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') >= 3 THEN 1.0 END AS sky FROM orders GROUP BY 1),
    b AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS kept, count(*) FILTER (WHERE o_orderstatus = 'P') AS unmeasured, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS guarded FROM orders GROUP BY 1)
    SELECT * FROM (SELECT o_custkey, array_to_string(list_filter([CASE WHEN kept > 0 THEN 'SUSPECT_BLOCK_KEPT' END, CASE WHEN unmeasured > 0 THEN 'SUSPECT_BLOCK_UNMEASURED' END, CASE WHEN sky IS NULL AND frames > 3 THEN 'NO_SKY_BASELINE' END, CASE WHEN guarded > 0 THEN 'SOFT_GUARD_KEPT' END], lambda x: x IS NOT NULL), '|') AS codes, kept, unmeasured, guarded FROM c JOIN b USING (o_custkey)) WHERE codes <> ''""",
)
def suspect_channels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    channels = o.groupBy("o_custkey").agg(F.count("*").alias("frames"), F.when(F.count_if(status == "F") >= 3, F.lit(1.0)).alias("sky_clean"))
    blocks = o.select("o_custkey", F.when(status == "F", "REMOVED").when(status == "O", "KEPT").alias("outcome"))
    decisions = o.select("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("A"), F.lit("SEL_SOFT_GUARD_KEPT"))).otherwise(F.array(F.lit("A"))).alias("reasons"))
    return cohort.suspect_channels(channels, blocks, decisions, ["o_custkey"]).withColumn("codes", F.array_join("codes", "|"))


@query(
    "metadata_overrides",
    """WITH f AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 5 = 0 THEN p_partkey - 1 ELSE p_partkey END AS d FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY d) AS fn FROM f),
    o AS (SELECT s_suppkey AS d, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 6 = 0), g AS (SELECT d, count(*) AS cnt, min(s_name) AS s_name FROM o GROUP BY 1)
    SELECT p_partkey, CASE WHEN cnt = 1 AND fn = 1 THEN s_name ELSE p_type END AS p_type, CASE WHEN cnt IS NOT NULL AND NOT (cnt = 1 AND fn = 1) THEN 'AMBIGUOUS' END AS override_error FROM n LEFT JOIN g USING (d)""",
)
def metadata_overrides(spark, sf_dir):
    frames = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).alias("digest"))
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("digest"), F.col("s_name").alias("p_type"))
    return cohort.overridden(frames, o.unionAll(o.where("digest % 6 = 0")), "digest", ["p_type"]).select("p_partkey", "p_type", "override_error")


@query(
    "joined_once",
    """WITH c AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 = 1), n AS (SELECT c_custkey, count(*) AS rn, min(c_name) AS c_name FROM c GROUP BY 1), o AS (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS ln FROM orders)
    SELECT o_orderkey, CASE WHEN rn = 1 AND ln = 1 THEN c_name END AS c_name, CASE WHEN ln > 1 OR rn > 1 THEN 'DUPLICATE' WHEN rn IS NULL THEN 'MISSING' END AS join_error FROM o LEFT JOIN n ON o_custkey = c_custkey""",
)
def joined_once(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    right = c.where("c_custkey % 4 <> 0").unionAll(c.where("c_custkey % 10 = 1")).withColumnRenamed("c_custkey", "o_custkey")
    return cohort.joined_once(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), right, ["o_custkey"]).select("o_orderkey", "c_name", "join_error")


@query(
    "trail_extent",
    """WITH e AS (SELECT event_type, event_id, value - 60 + CASE WHEN event_id % 400 < 120 THEN 60 ELSE 0 END AS v FROM events WHERE value IS NOT NULL), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e),
    m AS (SELECT *, sum(v) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) / 32 > 0.12 * 40 AS lit, abs(event_id - 450) AS gap FROM i WHERE n >= 32), c AS (SELECT event_type, i AS c FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY gap, i) AS k FROM m) WHERE k = 1),
    o AS (SELECT *, i - lag(i) OVER (PARTITION BY event_type ORDER BY event_id) - 1 > 64 AS fresh FROM m WHERE lit), u AS (SELECT o.*, c, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM o JOIN c USING (event_type)),
    b AS (SELECT event_type, run AS brun, abs(i - c) AS d, gap AS g FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(i - c), i) AS k FROM u) WHERE k = 1)
    SELECT event_type, min(event_id) AS "start", max(event_id) AS "stop" FROM u JOIN b USING (event_type) WHERE run = brun AND (d = 0 OR g <= 64) GROUP BY 1""",
)
def trail_extent(spark, sf_dir):
    v = F.col("value") - 60 + F.when(F.col("event_id") % 400 < 120, 60).otherwise(0)
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", v.alias("v"), F.lit(40.0).alias("sigma"), F.lit(450).alias("seed"))
    return cohort.trail_extent(rows, ["event_type"], "event_id", "v", "sigma", "seed")


SOFT = """WITH p AS (SELECT p_brand, p_partkey % 37 / 3.7 AS x, p_size / 5.1 AS y, p_retailprice AS v, 1 + p_size % 3 AS w FROM part)"""


def _drops(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 37 / 3.7).alias("x"), (F.col("p_size") / 5.1).alias("y"), F.col("p_retailprice").alias("v"), (1 + F.col("p_size") % 3).alias("w"))


@query("drizzle_point", SOFT + " SELECT p_brand, floor(y + 0.5)::INT AS oy, floor(x + 0.5)::INT AS ox, round(sum(w * v) / sum(w) + 1e-9, 4) AS value, sum(w)::DOUBLE AS weight, count(*)::DOUBLE AS coverage FROM p GROUP BY 1, 2, 3")
def drizzle_point(spark, sf_dir):
    return grids.splat_soft(_drops(spark, sf_dir), ["p_brand"], "x", "y", "v", "w", kernel="point").withColumn("value", r("value", 4))


@query(
    "drizzle_gaussian",
    SOFT
    + """, s AS (SELECT *, 0.8 / 2.3548200450309493 AS s, row_number() OVER () AS id FROM p), gx AS (SELECT id, unnest(generate_series(ceil(x - 3 * s)::INT, greatest(ceil(x - 3 * s), floor(x + 3 * s))::INT)) AS ox FROM s), gy AS (SELECT id, unnest(generate_series(ceil(y - 3 * s)::INT, greatest(ceil(y - 3 * s), floor(y + 3 * s))::INT)) AS oy FROM s),
    e AS (SELECT p_brand, id, oy, ox, v, w, exp(-(pow(ox - x, 2) + pow(oy - y, 2)) / (2 * s * s)) AS e FROM s JOIN gx USING (id) JOIN gy USING (id)), a AS (SELECT *, 0.8 * 0.8 * e / sum(e) OVER (PARTITION BY id) AS a FROM e)
    SELECT p_brand, oy, ox, round(sum(a * w * v) / sum(a * w) + 1e-9, 3) AS value, round(sum(a * w) + 1e-9, 6) AS weight, round(sum(a) + 1e-9, 6) AS coverage FROM a GROUP BY 1, 2, 3""",
)
def drizzle_gaussian(spark, sf_dir):
    out = grids.splat_soft(_drops(spark, sf_dir), ["p_brand"], "x", "y", "v", "w", 0.8)
    return out.select("p_brand", "oy", "ox", r("value", 3).alias("value"), r("weight").alias("weight"), r("coverage").alias("coverage"))


@query(
    "sample_lattice",
    """WITH s AS (SELECT s_suppkey, 10 + s_suppkey % 50 AS h, 5 + s_suppkey % 31 AS w FROM supplier), t AS (SELECT *, least(h, greatest(1, floor(sqrt(40 * h // w))::BIGINT)) AS r FROM s), u AS (SELECT *, least(w, greatest(1, 40 // r)) AS c FROM t),
    y AS (SELECT s_suppkey, CASE WHEN r <= 1 THEN 0 ELSE round_even(k * (h - 1) / (r - 1)::DOUBLE, 0)::BIGINT END AS y FROM u, LATERAL (SELECT unnest(range(r)) AS k)), x AS (SELECT s_suppkey, CASE WHEN c <= 1 THEN 0 ELSE round_even(k * (w - 1) / (c - 1)::DOUBLE, 0)::BIGINT END AS x FROM u, LATERAL (SELECT unnest(range(c)) AS k))
    SELECT DISTINCT s_suppkey, y, x FROM y JOIN x USING (s_suppkey)""",
)
def sample_lattice(spark, sf_dir):
    sizes = table(spark, sf_dir, "supplier").select("s_suppkey", (10 + F.col("s_suppkey") % 50).alias("h"), (5 + F.col("s_suppkey") % 31).alias("w"))
    return grids.sample_lattice(sizes, ["s_suppkey"], "h", "w", 40)


@query(
    "largest_rectangle",
    """WITH c AS (SELECT l_returnflag AS g, l_suppkey % 30 AS y, l_partkey % 40 AS x, count(*) % 4 <> 0 AS ok FROM lineitem GROUP BY 1, 2, 3), v AS (SELECT g, y, x, y - row_number() OVER (PARTITION BY g, x ORDER BY y) AS run FROM c WHERE ok), h AS (SELECT g, y, x, row_number() OVER (PARTITION BY g, x, run ORDER BY y) AS h FROM v),
    s AS (SELECT a.g, a.y, a.x AS x0, b.x AS x1, min(m.h) AS h FROM h a JOIN h b ON a.g = b.g AND a.y = b.y AND b.x >= a.x JOIN h m ON m.g = a.g AND m.y = a.y AND m.x BETWEEN a.x AND b.x GROUP BY 1, 2, 3, 4 HAVING count(*) = b.x - a.x + 1),
    k AS (SELECT g, h * (x1 - x0 + 1) AS area, y - h + 1 AS y0, x0, y + 1 AS y1, x1 + 1 AS x1 FROM s)
    SELECT g, area, y0, x0, y1, x1 FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY area DESC, y0 DESC, x0 DESC, y1 DESC, x1 DESC) AS k FROM k) WHERE k = 1""",
)
def largest_rectangle(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), (F.col("l_suppkey") % 30).alias("y"), (F.col("l_partkey") % 40).alias("x")).agg(F.count("*").alias("n"))
    return grids.largest_rectangle(cells, ["g"], "x", "y", F.col("n") % 4 != 0)


@query("mosaic_channel_medians", "SELECT l_returnflag, (l_suppkey % 2 * 2 + l_partkey % 2)::INT AS place, count(l_extendedprice) AS n, round(median(l_extendedprice) + 1e-9, 4) AS median FROM lineitem GROUP BY 1, 2")
def mosaic_channel_medians(spark, sf_dir):
    return grids.channel_medians(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "l_suppkey", "l_extendedprice").withColumn("median", r("median", 4))


_K = "CASE WHEN p_partkey % {m} <> 0 THEN {v} END AS {n}"
_FEATURES = {  # no value lies on a threshold
    "dimming": "p_partkey % 13 / 21.7e0", "completeness": "0.33e0 + p_partkey % 8 / 10.3e0", "source_ratio": "0.31e0 + p_partkey % 9 / 9.1e0", "extinction": "p_partkey % 23 / 30.7e0", "background": "p_retailprice", "area": "p_partkey % 29 / 71.3e0",
    "density": "p_partkey % 7 / 9.1e0", "boundary": "p_partkey % 4 / 3.7e0", "support": "p_partkey % 3 / 2.7e0", "hfr": "2.017e0 + p_size / 91.3e0", "fwhm": "3.013e0 + p_size % 17 / 30.7e0", "ellipticity": "0.2013e0 + p_size % 11 / 41.7e0", "ellipticity_p90": "0.4011e0 + p_size % 13 / 31.3e0",
}
_CONFIDENCE = "CASE WHEN p_partkey % 19 = 0 THEN 'LOW' WHEN p_partkey % 3 = 0 THEN 'MEDIUM' ELSE 'HIGH' END"


def _features(cast: str) -> str:
    return ", ".join(_K.format(m=m, v=f"cast({v} AS {cast})", n=n) for m, (n, v) in zip((17, 19, 31, 5, 37, 41, 43, 11, 13, 47, 53, 59, 61), _FEATURES.items()))


@query(
    "scored_decisions",
    f"""WITH f AS (SELECT p_partkey, p_brand, {_features("DOUBLE")}, {_CONFIDENCE} AS confidence FROM part),
    m AS (SELECT p_brand, median(background) AS mb, median(hfr) AS mh, median(fwhm) AS mf, median(ellipticity) AS me, median(ellipticity_p90) AS mp FROM f GROUP BY 1),
    s AS (SELECT p_brand, 1.4826 * median(abs(background - mb)) AS sb, 1.4826 * median(abs(hfr - mh)) AS sh, 1.4826 * median(abs(fwhm - mf)) AS sf, 1.4826 * median(abs(ellipticity - me)) AS se, 1.4826 * median(abs(ellipticity_p90 - mp)) AS sp FROM f JOIN m USING (p_brand) GROUP BY 1),
    t AS (SELECT f.*, CASE WHEN dimming >= 0.45 THEN 2 WHEN dimming >= 0.18 THEN 1 ELSE 0 END AS d, CASE WHEN completeness <= 0.45 THEN 2 WHEN completeness <= 0.7 THEN 1 ELSE 0 END AS c, CASE WHEN source_ratio <= 0.45 THEN 2 WHEN source_ratio <= 0.7 THEN 1 ELSE 0 END AS n,
      CASE WHEN extinction >= 0.45 THEN 2 WHEN extinction >= 0.35 THEN 1 ELSE 0 END AS e, CASE WHEN abs(background - mb) / greatest(sb, 1e-8) >= 3 THEN 1 ELSE 0 END AS b, coalesce(area, 0) AS ar, coalesce(boundary, 0) AS bo, coalesce(support, 0) >= 0.5 AS su, coalesce(density <= 0.35, false) AS d1, coalesce(density <= 0.15, false) AS d2,
      coalesce(hfr >= 1.15 * mh OR (sh > 1e-9 AND hfr >= 1.08 * mh AND hfr - mh >= 4 * sh), false) AS oh, coalesce(fwhm >= 1.18 * mf OR (sf > 1e-9 AND fwhm >= 1.08 * mf AND fwhm - mf >= 4 * sf), false) AS of,
      coalesce(ellipticity >= 0.35 AND (ellipticity >= 1.5 * me OR (se > 1e-9 AND ellipticity >= 1.2 * me AND ellipticity - me >= 4 * se)), false) OR coalesce(ellipticity_p90 >= 0.65 AND (ellipticity_p90 >= 1.4 * mp OR (sp > 1e-9 AND ellipticity_p90 >= 1.15 * mp AND ellipticity_p90 - mp >= 4 * sp)), false) AS tr FROM f JOIN m USING (p_brand) JOIN s USING (p_brand)),
    u AS (SELECT *, CASE WHEN extinction IS NULL OR extinction >= 0.35 THEN n ELSE 0 END AS np, CASE WHEN extinction >= 0.35 THEN n ELSE 0 END AS nf, ar >= 0.15 AND d2 AND su AND bo >= 0.65 AS hard, ar >= 0.3 AND d1 AND su AS vast FROM t),
    v AS (SELECT *, d + c + np + e + b AS cloud_score, (d > 0)::INT + (c > 0)::INT + (nf > 0)::INT + (e > 0)::INT + b AS fam, d = 2 OR c = 2 OR nf = 2 OR e = 2 AS strong, CASE WHEN ar >= 0.05 THEN 1 + d1::INT + (bo >= 0.5)::INT + su::INT ELSE 0 END AS oc, CASE WHEN tr OR oh THEN 2 WHEN of THEN 1 ELSE 0 END AS shape_score FROM u),
    x AS (SELECT *, CASE WHEN hard OR vast THEN greatest(oc, 5) ELSE oc END AS occlusion_score FROM v)
    SELECT p_partkey, cloud_score, occlusion_score, shape_score, CASE WHEN (hard OR vast) AND confidence = 'HIGH' THEN 'REJECT_OCCLUSION' WHEN confidence = 'HIGH' AND cloud_score >= 4 AND fam >= 2 AND strong THEN 'REJECT_CLOUD' WHEN cloud_score >= 2 OR occlusion_score >= 2 OR shape_score >= 2 THEN 'REVIEW' WHEN confidence IN ('MEDIUM', 'HIGH') THEN 'KEEP' ELSE 'UNASSESSABLE' END AS decision,
    (d > 0)::INT + (c > 0)::INT + (np > 0)::INT + (e > 0)::INT + b + CASE WHEN ar >= 0.05 THEN oc ELSE 0 END + (hard OR vast)::INT + (oh OR of)::INT + tr::INT AS reasons FROM x""",
)
def scored_decisions(spark, sf_dir):
    """The rule set over made-up features of parts, with unknown ones among them."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", *_features("double").split(", CASE")[:1], *["CASE" + c for c in _features("double").split(", CASE")[1:]], f"{_CONFIDENCE} AS confidence")
    out = scores.scored_decisions(rows, ["p_brand"], "confidence")
    return out.select("p_partkey", "cloud_score", "occlusion_score", "shape_score", "decision", F.size("reasons").alias("reasons"))
