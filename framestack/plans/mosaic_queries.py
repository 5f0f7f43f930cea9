"""Networks of panels, sky bins, stacks with frames taken out, line rejection, fields by their heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping, mosaic, retract, stack
from .registry import query, r, table
from .stack_queries import CLIPPED


@query(
    "panel_scales",
    """WITH a AS (SELECT c_nationkey AS nation, avg(c_acctbal) AS m FROM customer GROUP BY 1)
    SELECT nation::INT AS nation, round(m - (SELECT avg(m) FROM a) + 1e-9, 3) AS gain FROM a""",
)
def panel_scales(spark, sf_dir):
    """Offsets of nations from the differences of their customers' mean balances along a ring with chords; the differences agree, so
    the solution is known."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("a")).agg(F.avg("c_acctbal").alias("ma"))
    near = c.select((F.col("a") + 0).alias("b"), F.col("ma").alias("mb"))
    edges = c.withColumn("b", F.explode(F.array((F.col("a") + 1) % 25, (F.col("a") + 7) % 25))).join(near, "b")
    one = F.array(F.lit(1.0))
    rows = edges.select(*mosaic.network_rows(F.col("a"), F.col("b"), one, one, F.col("ma") - F.col("mb"), F.lit(10.0)))
    panels = c.select(F.col("a").cast("string").alias("panel"), (F.col("a") % 5 * 10).alias("x0"), (F.floor(F.col("a") / 5) * 10).alias("y0"), (F.col("a") % 5 * 10 + 10).alias("x1"), (F.floor(F.col("a") / 5) * 10 + 10).alias("y1"))
    found = mosaic.solve(rows, 1, mosaic.placed(panels)).select(F.col("panel").cast("int").alias("nation"), F.col("x")[0].alias("g"))
    return found.crossJoin(F.broadcast(found.agg(F.avg("g").alias("mean")))).select("nation", r(F.col("g") - F.col("mean"), 3).alias("gain"))  # one row


PRICES = "SELECT l_partkey % 25 AS p, l_orderkey % 5 AS s, ln(avg(l_extendedprice)) AS m FROM lineitem GROUP BY 1, 2"


@query(
    "mosaic_scales",
    f"""WITH c AS ({PRICES}),
    d AS (SELECT a.p, b.p AS q, CASE WHEN a.p < b.p THEN b.m - a.m ELSE b.m - a.m END AS d FROM c a JOIN c b ON a.p <> b.p AND a.s = (a.p + b.p) % 5 AND b.s = a.s),
    x AS (SELECT p, sum(d) / 25 AS x FROM d GROUP BY 1)
    SELECT p::VARCHAR AS panel, 'scale' AS model, round(x - (SELECT min(x) FROM x) + 1e-9, 6) AS log_scale FROM x""",
)
def mosaic_scales(spark, sf_dir):
    """Scales of 25 panels of parts, each pair measured once in one of five bands; the ratios of a cycle do not agree.

    All errors are equal and wide, so no residual is re-weighted and the solution on this complete network is each panel's
    mean difference; the criterion keeps one scale a panel.
    """
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 25).alias("p"), (F.col("l_orderkey") % 5).alias("s")).agg(F.log(F.avg("l_extendedprice")).alias("m"))
    d = c.select(F.col("p").alias("q"), "s", F.col("m").alias("mq"))
    met = c.join(d, "s").where((F.col("p") < F.col("q")) & (F.col("s") == (F.col("p") + F.col("q")) % 5))
    at = lambda c: (F.col(c) % 5 * 100.0, F.floor(F.col(c) / 5) * 100.0)
    middle = lambda i: (at("p")[i] + at("q")[i]) / 2 + 50
    observations = met.select(F.col("p").cast("string").alias("left"), F.col("q").cast("string").alias("right"), middle(0).alias("x"), middle(1).alias("y"), (F.col("m") - F.col("mq")).alias("log_ratio"), F.lit(0.5).alias("error"))
    x0, y0 = at("p")
    panels = c.select("p").distinct().select(F.col("p").cast("string").alias("panel"), x0.alias("x0"), y0.alias("y0"), (x0 + 100).alias("x1"), (y0 + 100).alias("y1"), F.lit(1.0).alias("exposure"))
    return mosaic.scales(observations, panels).select("panel", "model", r("log_scale").alias("log_scale"))


PIXELS = "SELECT floor(l_orderkey / 4096)::INT::VARCHAR AS panel, l_partkey * 7919 % 64 AS x, (l_suppkey * 31 + l_linenumber * 17 + l_orderkey * 13) % 64 AS y, l_extendedprice AS v FROM lineitem"


@query(
    "mosaic_sky_bins",
    f"""WITH p AS (SELECT * FROM ({PIXELS}) WHERE x % 2 = 0 AND y % 2 = 0),
    m AS (SELECT panel, median(v) AS value, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 512),
    d AS (SELECT panel, median(abs(v - value)) AS mad FROM p JOIN m USING (panel) GROUP BY 1)
    SELECT panel, 0 AS col, 0 AS row, 32.0 AS x, 32.0 AS y, round(value + 1e-9, 4) AS value, round(1.4826 * mad + 1e-9, 4) AS noise FROM m JOIN d USING (panel)""",
)
def mosaic_sky_bins(spark, sf_dir):
    """Sky of panels of one bin each: a panel is a range of orders, a pixel a line of them."""
    li = table(spark, sf_dir, "lineitem")
    pixels = li.select(F.floor(F.col("l_orderkey") / 4096).cast("int").cast("string").alias("panel"), (F.col("l_partkey") * 7919 % 64).alias("x"), ((F.col("l_suppkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_orderkey") * 13) % 64).alias("y"), F.col("l_extendedprice").alias("value"))
    zero, side = F.lit(0), F.lit(mosaic.SKY_PIXELS)
    panels = pixels.select("panel").distinct().select("panel", zero.alias("x0"), zero.alias("y0"), side.alias("x1"), side.alias("y1"))
    return mosaic.sky_bins(pixels, panels).select("panel", "col", "row", "x", "y", r("value", 4).alias("value"), r("noise", 4).alias("noise"))


@query(
    "stack_retracted",
    CLIPPED.replace("FROM lineitem", "FROM (SELECT * FROM lineitem WHERE l_suppkey % 10 NOT IN (3, 7))", 1).replace("FROM lineitem l JOIN", "FROM (SELECT * FROM lineitem WHERE l_suppkey % 10 NOT IN (3, 7)) l JOIN")
    + """SELECT l_partkey, max(n) AS n, round(sum(CASE WHEN ok THEN l_quantity * l_extendedprice END) / sum(CASE WHEN ok THEN l_quantity END) + 1e-9, 3) AS mean,
    count(*) FILTER (WHERE ok) AS n_accepted, max(n) - count(*) FILTER (WHERE ok) AS n_rejected FROM c GROUP BY 1""",
)
def stack_retracted(spark, sf_dir):
    """A stack of which two sets of suppliers are taken out, one after the other; the SQL stacks from scratch without them."""
    li = table(spark, sf_dir, "lineitem")
    made = retract.build(li, ["l_partkey"], "l_suppkey", "l_extendedprice", "l_quantity")
    frames = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"))
    for digit in (3, 7):
        made = retract.remove(made, frames.where(F.col("frame") % 10 == digit))
    return made.result().select("l_partkey", "n", r("mean", 3).alias("mean"), "n_accepted", "n_rejected")


@query(
    "removal_limits",
    """WITH f AS (SELECT s_suppkey AS frame, s_nationkey AS panel, s_suppkey % 11 = 0 AS ref, s_acctbal < 4000 AS harm FROM supplier),
    n AS (SELECT panel, count(*) FILTER (WHERE NOT (harm AND NOT ref)) AS stay FROM f GROUP BY 1),
    h AS (SELECT f.*, stay, row_number() OVER (PARTITION BY f.panel ORDER BY (NOT ref) DESC, frame) AS k FROM f JOIN n USING (panel) WHERE harm),
    g AS (SELECT *, NOT ref AND k <= 2 - stay AS held FROM h),
    o AS (SELECT *, row_number() OVER (ORDER BY (NOT ref AND NOT held) DESC, frame) AS rank FROM g)
    SELECT frame, NOT ref AND NOT held AND rank <= floor(0.1 * (SELECT count(*) FROM f) + 1e-9) AS removed,
      CASE WHEN ref THEN 'REFERENCE' WHEN held THEN 'PANEL_MINIMUM' WHEN rank > floor(0.1 * (SELECT count(*) FROM f) + 1e-9) THEN 'FRACTION_GUARD' END AS because FROM o""",
)
def removal_limits(spark, sf_dir):
    """Which suppliers of low balance may go: references and the last two of a nation stay, and at most a tenth goes."""
    s = table(spark, sf_dir, "supplier")
    frames = s.select(F.col("s_suppkey").alias("frame"), F.col("s_nationkey").alias("panel"), (F.col("s_suppkey") % 11 == 0).alias("is_reference"))
    return retract.removable(s.where("s_acctbal < 4000").select(F.col("s_suppkey").alias("frame")), frames, s.count(), 0)


def _linear_sql(key: str, value: str, weight: str, bisections: int = 10, rounds: int = 8) -> str:
    """The rounds written out, each a chain of materialised tables."""
    parts = [f"r0 AS MATERIALIZED (SELECT {key}, list({{'v': {value}::DOUBLE, 'w': {weight}::DOUBLE}} ORDER BY {value}::DOUBLE, {weight}::DOUBLE) AS s, count(*) AS n FROM lineitem WHERE {weight} > 0 GROUP BY 1)"]
    at = "list_aggregate(list_transform(s, lambda x, i: x.v - slope * (i - 1)), 'median')"
    for k in range(rounds):
        parts.append(f"b{k}_0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS lo, CASE WHEN len(s) > 1 THEN greatest(1e-12, 4.0 * (s[len(s)].v - s[1].v) / (len(s) - 1)) ELSE 0 END AS up FROM r{k})")
        for b in range(bisections):
            parts.append(f"""b{k}_{b + 1} AS MATERIALIZED (SELECT {key}, s, n, CASE WHEN score > 0 THEN slope ELSE lo END AS lo, CASE WHEN score > 0 THEN up ELSE slope END AS up FROM
            (SELECT *, list_sum(list_transform(s, lambda x, i: (i - 1) * sign(x.v - (a + slope * (i - 1))))) AS score FROM (SELECT *, {at} AS a FROM (SELECT *, 0.5 * (lo + up) AS slope FROM b{k}_{b}))))""")
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT {key}, CASE WHEN len(s) >= 5 AND scale > 0 AND 1.0 + scale <> 1.0 THEN
            list_filter(s, lambda x, i: (x.v - (a + slope * (i - 1))) / scale >= -5.0 AND (x.v - (a + slope * (i - 1))) / scale <= 3.5) ELSE s END AS s, n FROM
            (SELECT *, 2.0 * list_sum(list_transform(s, lambda x, i: abs(x.v - (a + slope * (i - 1))))) / len(s) * sqrt(1.0 + slope * slope) AS scale FROM (SELECT *, {at} AS a FROM (SELECT *, 0.5 * (lo + up) AS slope FROM b{k}_{bisections}))))""")
    return f"""WITH {", ".join(parts)} SELECT {key}, n, round(list_sum(list_transform(s, lambda x: x.v * x.w)) / list_sum(list_transform(s, lambda x: x.w)) + 1e-9, 3) AS mean,
        len(s) AS n_accepted, n - len(s) AS n_rejected FROM r{rounds}"""


@query("stack_linear_fit", _linear_sql("l_partkey", "l_extendedprice", "l_quantity"))
def stack_linear_fit(spark, sf_dir):
    out = stack.linear_fit(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", "l_quantity")
    return out.select("l_partkey", "n", r("mean", 3).alias("mean"), "n_accepted", "n_rejected")


@query(
    "fields_by_heads",
    """WITH RECURSIVE g AS (SELECT c_nationkey, list({'f': c_custkey, 'v': c_acctbal::DOUBLE} ORDER BY -(c_custkey % 7), c_custkey) AS rest FROM customer GROUP BY 1),
    w AS (
      SELECT c_nationkey, rest[1] AS head, list_filter(rest, lambda r: r.f = rest[1].f OR abs(r.v - rest[1].v) <= 2500) AS taken,
        list_filter(rest, lambda r: NOT (r.f = rest[1].f OR abs(r.v - rest[1].v) <= 2500)) AS rest, 1 AS field FROM g
      UNION ALL
      SELECT c_nationkey, rest[1], list_filter(rest, lambda r: r.f = rest[1].f OR abs(r.v - rest[1].v) <= 2500),
        list_filter(rest, lambda r: NOT (r.f = rest[1].f OR abs(r.v - rest[1].v) <= 2500)), field + 1 FROM w WHERE len(rest) > 0)
    SELECT c_nationkey, unnest(taken).f AS c_custkey, head.f AS head, field FROM w""",
)
def fields_by_heads(spark, sf_dir):
    """Customers of a nation split by heads that accept balances within 2,500 of their own; most orders first."""
    c = table(spark, sf_dir, "customer")
    own = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("v"))

    def accepts(pairs):
        a, b = own.select(F.col("k").alias("c_custkey"), F.col("v").alias("va")), own.select(F.col("k").alias("head"), F.col("v").alias("vb"))
        return pairs.join(a, "c_custkey").join(b, "head").where(F.abs(F.col("va") - F.col("vb")) <= 2500)

    return grouping.split_by_heads(c, ["c_nationkey"], "c_custkey", [-(F.col("c_custkey") % 7)], accepts)
