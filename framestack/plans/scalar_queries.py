"""Scalar functions: names, sky arithmetic, JSON and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky, text
from .registry import query, r, table


@query(
    "filter_alias",
    """SELECT p_partkey, CASE folded WHEN 'LUM' THEN 'L' WHEN 'RED' THEN 'R' WHEN 'GREEN' THEN 'G' WHEN 'BLUE' THEN 'B' WHEN 'HALPHA' THEN 'HA' WHEN 'OIII' THEN 'OIII' ELSE upper(p_brand) END AS filter_name
    FROM (SELECT p_partkey, p_brand, regexp_replace(upper(CASE p_partkey % 7 WHEN 0 THEN 'lum' WHEN 1 THEN 'Red ' WHEN 2 THEN 'gre-en' WHEN 3 THEN 'B_lue' WHEN 4 THEN 'H-alpha' WHEN 5 THEN 'O III' ELSE p_brand END), '[^A-Z0-9]+', '', 'g') AS folded FROM part)""",
)
def filter_alias(spark, sf_dir):
    k = F.col("p_partkey") % 7
    name = F.coalesce(*[F.when(k == i, F.lit(v)) for i, v in enumerate(("lum", "Red ", "gre-en", "B_lue", "H-alpha", "O III"))], F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.filter_name(name).alias("filter_name"))


@query(
    "role_parse",
    "SELECT doc_id, CASE regexp_replace(upper(CASE doc_id % 4 WHEN 0 THEN 'Light Frame' WHEN 1 THEN 'master-dark' WHEN 2 THEN 'flat_field' ELSE lang END), '[^A-Z0-9]+', '', 'g') WHEN 'LIGHTFRAME' THEN 'LIGHT' WHEN 'MASTERDARK' THEN 'MASTER_DARK' WHEN 'FLATFIELD' THEN 'FLAT' END AS role FROM documents",
)
def role_parse(spark, sf_dir):
    k = F.col("doc_id") % 4
    value = F.when(k == 0, "Light Frame").when(k == 1, "master-dark").when(k == 2, "flat_field").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.frame_role(value).alias("role"))


@query(
    "path_keywords",
    """SELECT o_orderkey, nullif(trim(regexp_extract(p, 'NIGHT[_\\- ]([-():. A-Za-z0-9]+)', 1)), '') AS night, nullif(trim(regexp_extract(p, 'PANEL[_\\- ]([-():. A-Za-z0-9]+)', 1)), '') AS panel, try_cast(nullif(regexp_extract(p, '_([0-9]+)s_', 1), '') AS DOUBLE) AS seconds
    FROM (SELECT o_orderkey, 'root/PANEL-' || (o_custkey % 9) || ' (east)/NIGHT_' || strftime(o_orderdate, '%Y-%m-%d') || '/light_' || (30 + o_orderkey % 5 * 30) || 's_' || o_orderkey || '.fits' AS p FROM orders)""",
)
def path_keywords(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("root/PANEL-"), (F.col("o_custkey") % 9).cast("string"), F.lit(" (east)/NIGHT_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/light_"), (30 + F.col("o_orderkey") % 5 * 30).cast("string"), F.lit("s_"), F.col("o_orderkey").cast("string"), F.lit(".fits"))
    k = text.path_keywords(path, ["NIGHT", "PANEL"])
    return o.select("o_orderkey", F.element_at(k, "NIGHT").alias("night"), F.element_at(k, "PANEL").alias("panel"), text.seconds_in_name(text.innermost(path)).alias("seconds"))


@query(
    "sky_arithmetic",
    """SELECT l_orderkey, l_linenumber, round(-2.5 * log10(l_extendedprice / 1000) + 1e-9, 6) AS magnitude,
    round(1 / sin(radians(a + 244 / (165 + 47 * pow(a, 1.1)))) + 1e-9, 6) AS airmass, round(206.265 * (1 + l_tax) / l_quantity + 1e-9, 6) AS pixel_scale
    FROM (SELECT *, 5.0 + (l_quantity * 1.7) AS a FROM lineitem)""",
)
def sky_arithmetic(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", r(sky.magnitude(F.col("l_extendedprice") / 1000)).alias("magnitude"),
        r(sky.airmass(5.0 + F.col("l_quantity") * 1.7)).alias("airmass"), r(sky.pixel_scale(1 + F.col("l_tax"), F.col("l_quantity"))).alias("pixel_scale"),
    )


@query(
    "stretch_mtf",
    """SELECT p_partkey, round((0.25 - 1) * x / ((0.5 - 1) * x - 0.25) + 1e-9, 6) AS midtones, round(asinh(x / 0.05) / asinh(20.0) + 1e-9, 6) AS stretched FROM (SELECT p_partkey, least(1.0, p_retailprice / 2500) AS x FROM part)""",
)
def stretch_mtf(spark, sf_dir):
    x = F.least(F.lit(1.0), F.col("p_retailprice") / 2500)
    return table(spark, sf_dir, "part").select("p_partkey", r(sky.midtones(x, 0.25)).alias("midtones"), r(sky.asinh_stretch(x)).alias("stretched"))


@query(
    "positions",
    """WITH p AS (SELECT c_custkey, c_custkey * 7 % 360 * 1.0 AS ra, c_nationkey * 5 - 60.0 AS dec FROM customer)
    SELECT c_custkey, round(degrees(2 * asin(least(1.0, sqrt(pow(sin(radians((10 - dec) / 2)), 2) + cos(radians(dec)) * cos(radians(10.0)) * pow(sin(radians((40 - ra) / 2)), 2))))) + 1e-9, 6) AS separation,
    round((2 * ra + 3 * dec + 5) / (0.001 * ra + 2) + 1e-9, 6) AS u, round((ra - dec) / (0.001 * ra + 2) + 1e-9, 6) AS v FROM p""",
)
def positions(spark, sf_dir):
    ra, dec = F.col("c_custkey") * 7 % 360 * 1.0, F.col("c_nationkey") * 5 - 60.0
    u, v = sky.homography([2, 3, 5, 1, -1, 0, 0.001, 0, 2], ra, dec)
    return table(spark, sf_dir, "customer").select("c_custkey", r(sky.separation(ra, dec, F.lit(40.0), F.lit(10.0))).alias("separation"), r(u).alias("u"), r(v).alias("v"))


@query(
    "mean_pointing",
    """SELECT c_nationkey, round(degrees(atan2(avg(sin(radians(c_custkey * 1.0))), avg(cos(radians(c_custkey * 1.0))))) + CASE WHEN degrees(atan2(avg(sin(radians(c_custkey * 1.0))), avg(cos(radians(c_custkey * 1.0))))) < 0 THEN 360 ELSE 0 END + 1e-9, 4) AS ra, round(median(c_acctbal) + 1e-9, 4) AS dec FROM customer GROUP BY 1""",
)
def mean_pointing(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(r(sky.mean_angle(F.col("c_custkey").cast("double")), 4).alias("ra"), r(F.percentile("c_acctbal", F.lit(0.5)), 4).alias("dec"))


@query(
    "semi_structured_header",
    "SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k, len(json_keys(props)) AS keys, sha256(props) AS digest FROM events",
)
def semi_structured_header(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    header = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.element_at(header, "k").cast("int").alias("k"), F.size(F.map_keys(header)).cast("long").alias("keys"), F.sha2("props", 256).alias("digest"))


@query("csv_cells", "SELECT page_id, CASE WHEN regexp_matches(u, '^[=+@-]') THEN chr(39) || u ELSE u END AS cell, regexp_extract(url, '([^/]*/?[^/]*)$', 1) AS tail FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '=' || url ELSE url END AS u FROM pages)")
def csv_cells(spark, sf_dir):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("="), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.csv_safe(u).alias("cell"), text.redacted_path(F.col("url")).alias("tail"))
