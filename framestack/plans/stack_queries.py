"""Stack reduction: cell = part, frame = supplier or line number, value = extended price, weight = quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, stack, stats
from .registry import query, r, table

CLIPPED = """
WITH m AS (SELECT l_partkey, count(l_extendedprice) AS n, median(l_extendedprice) AS med FROM lineitem GROUP BY 1),
a AS (SELECT l.*, n, med, abs(l_extendedprice - med) AS d FROM lineitem l JOIN m USING (l_partkey)),
s AS (SELECT l_partkey, median(d) AS mad FROM a GROUP BY 1),
b AS (SELECT a.*, mad, greatest(1.4826 * mad, 1e-7, greatest(1e-7, 16 * pow(2, -23) * greatest(1.0, abs(med)))) AS sigma FROM a JOIN s USING (l_partkey)),
c AS (SELECT *, (n < 3 OR d <= 4.0 * sigma) AS ok FROM b)
"""


@query(
    "stack_clip_mean",
    CLIPPED
    + """SELECT l_partkey, max(n) AS n, round(max(med) + 1e-9, 4) AS med, round(max(mad) + 1e-9, 4) AS mad,
    round(sum(CASE WHEN ok THEN l_quantity * l_extendedprice END) / sum(CASE WHEN ok THEN l_quantity END) + 1e-9, 4) AS mean,
    count(*) FILTER (WHERE ok) AS n_accepted, max(n) - count(*) FILTER (WHERE ok) AS n_rejected FROM c GROUP BY 1""",
)
def stack_clip_mean(spark, sf_dir):
    out = stack.clip_mean(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", "l_quantity")
    return out.select("l_partkey", "n", r("med", 4).alias("med"), r("mad", 4).alias("mad"), r("mean", 4).alias("mean"), "n_accepted", "n_rejected")


@query(
    "stack_clip_mean_large_groups",
    CLIPPED.replace("l_partkey", "l_linestatus")
    + """SELECT l_linestatus, max(n) AS n, round(max(med) + 1e-9, 4) AS med, round(max(mad) + 1e-9, 4) AS mad,
    round(sum(CASE WHEN ok THEN l_quantity * l_extendedprice END) / sum(CASE WHEN ok THEN l_quantity END) + 1e-9, 3) AS mean,
    count(*) FILTER (WHERE ok) AS n_accepted, max(n) - count(*) FILTER (WHERE ok) AS n_rejected FROM c GROUP BY 1""",
)
def stack_clip_mean_large_groups(spark, sf_dir):
    out = stack.clip_mean_large(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", "l_quantity")
    return out.select("l_linestatus", "n", r("med", 4).alias("med"), r("mad", 4).alias("mad"), r("mean", 3).alias("mean"), "n_accepted", "n_rejected")


@query(
    "stack_irls_huber",
    CLIPPED
    + """, m0 AS (SELECT l_partkey, sum(CASE WHEN ok THEN l_quantity * l_extendedprice END) / sum(CASE WHEN ok THEN l_quantity END) AS mean FROM c GROUP BY 1)"""
    + "".join(
        f""", m{i} AS (SELECT l_partkey, sum(u * l_extendedprice) / sum(u) AS mean FROM (SELECT c.l_partkey, l_extendedprice,
        l_quantity * least(1.0, 1.345 / greatest(abs(l_extendedprice - mean) / sigma, 1.345)) AS u FROM c JOIN m{i - 1} USING (l_partkey)) GROUP BY 1)"""
        for i in range(1, 5)
    )
    + "SELECT l_partkey, round(mean + 1e-9, 3) AS mean FROM m4",
)
def stack_irls_huber(spark, sf_dir):
    out = stack.huber_mean(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", "l_quantity")
    return out.select("l_partkey", r("mean", 3).alias("mean"))


@query(
    "pixel_stats_partial",
    """SELECT l_suppkey, count(l_discount) AS finite, count(*) - count(l_discount) AS invalid, min(l_discount) AS low, max(l_discount) AS high,
    round(avg(l_discount) + 1e-9, 8) AS mean FROM lineitem GROUP BY 1""",
)
def pixel_stats_partial(spark, sf_dir):
    out = stack.cell_statistics(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount")
    return out.withColumn("mean", r("mean", 8))


@query(
    "stack_v2_scale",
    """WITH m AS (SELECT l_suppkey, l_partkey, count(*) AS n, median(l_extendedprice) AS med FROM lineitem GROUP BY 1, 2),
    a AS (SELECT l.*, n, med, abs(l_extendedprice - med) AS d FROM lineitem l JOIN m USING (l_suppkey, l_partkey)),
    s AS (SELECT l_suppkey, l_partkey, max(n) AS n, median(d) AS mad FROM a GROUP BY 1, 2),
    p AS (SELECT l_suppkey, l_partkey, mad, 1.4826 * quantile_cont(CASE WHEN n >= 3 THEN mad END, 0.5) OVER (PARTITION BY l_suppkey ORDER BY l_partkey ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS pool FROM s),
    f AS (SELECT l_linenumber, median(CASE WHEN n >= 3 THEN d END) AS fm FROM a GROUP BY 1),
    x AS (SELECT median(CASE WHEN n >= 3 THEN d END) AS mm FROM a),
    k AS (SELECT l_linenumber, coalesce(round(greatest(1.0, fm / nullif(mm, 0)), 5), 1.0) AS factor FROM f, x)
    SELECT l_orderkey, l_linenumber, round(greatest(sqrt(pow(factor * pool, 2) + greatest(pow(1.4826 * mad, 2) - pool * pool, 0)), greatest(1e-7, 16 * pow(2, -23) * greatest(1.0, abs(med)))) + 1e-9, 3) AS sigma
    FROM a JOIN p USING (l_suppkey, l_partkey) JOIN k USING (l_linenumber)""",
)
def stack_v2_scale(spark, sf_dir):
    out = stack.pooled_scale(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", r("sigma", 3).alias("sigma"))


@query(
    "noise_weights",
    """WITH a AS (SELECT l_suppkey, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS d FROM lineitem),
    m AS (SELECT l_suppkey, median(d) AS med FROM a GROUP BY 1),
    s AS (SELECT l_suppkey, 1.4826 * median(abs(d - med)) / sqrt(2) AS sigma FROM a JOIN m USING (l_suppkey) GROUP BY 1),
    w AS (SELECT *, CASE WHEN sigma > 0 THEN 1 / (sigma * sigma) ELSE 1.0 END AS raw FROM s),
    c AS (SELECT l_suppkey, sigma, least(greatest(raw, mid / 16), mid * 16) AS raw FROM w, (SELECT median(raw) AS mid FROM w))
    SELECT l_suppkey, round(sigma + 1e-9, 4) AS sigma, round(raw / sum(raw) OVER () + 1e-9, 8) AS weight FROM c""",
)
def noise_weights(spark, sf_dir):
    out = stack.noise_weights(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_extendedprice")
    return out.select("l_suppkey", r("sigma", 4).alias("sigma"), r("weight", 8).alias("weight"))


@query(
    "robust_z_score",
    """WITH m AS (SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS med FROM lineitem GROUP BY 1, 2),
    s AS (SELECT l_returnflag, l_linestatus, median(abs(l_extendedprice - med)) AS mad FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - med) / (1.4826 * mad) + 1e-9, 6) AS z FROM lineitem JOIN m USING (l_returnflag, l_linestatus) JOIN s USING (l_returnflag, l_linestatus)""",
)
def robust_z_score(spark, sf_dir):
    """The groups are few and large, so medians come from the bin-refining quantile, not from a window."""
    rows, keys = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    med = joins.held(stats.exact_quantile(rows, keys, "l_extendedprice").withColumnRenamed("quantile", "med"))
    dev = rows.join(med, keys).withColumn("d", F.abs(F.col("l_extendedprice") - F.col("med")))
    mad = joins.held(stats.exact_quantile(dev, keys, "d").withColumnRenamed("quantile", "mad"))
    z = (F.col("l_extendedprice") - F.col("med")) / (stats.MADN * F.col("mad"))
    return dev.join(mad, keys).select("l_orderkey", "l_linenumber", r(F.when(F.col("mad") > 0, z)).alias("z"))


@query(
    "leave_one_out_mean",
    """SELECT l_orderkey, l_linenumber, round((sum(l_quantity * l_extendedprice) OVER w - l_quantity * l_extendedprice) / nullif(sum(l_quantity) OVER w - l_quantity, 0) + 1e-9, 3) AS mean_without
    FROM lineitem WINDOW w AS (PARTITION BY l_partkey)""",
)
def leave_one_out_mean(spark, sf_dir):
    out = stack.leave_one_out(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", r("mean_without", 3).alias("mean_without"))


@query(
    "leave_block_out",
    """WITH p AS (SELECT l_returnflag, l_suppkey, count(l_extendedprice) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, l_suppkey, n, round((sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) + 1e-9, 3) AS mean_without FROM p WINDOW w AS (PARTITION BY l_returnflag)""",
)
def leave_block_out(spark, sf_dir):
    out = stack.leave_group_out(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey", "l_extendedprice")
    return out.withColumn("mean_without", r("mean_without", 3))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return stack.bootstrap_interval(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


@query(
    "weights_normalised",
    """SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) + 1e-9, 8) AS weight,
    round(l_extendedprice / quantile_cont(l_extendedprice, 0.5) OVER (PARTITION BY l_orderkey) + 1e-9, 6) AS relative FROM lineitem""",
)
def weights_normalised(spark, sf_dir):
    w = stats.over(["l_orderkey"])
    middle = F.percentile("l_extendedprice", F.lit(0.5)).over(w)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", r(F.col("l_quantity") / F.sum("l_quantity").over(w), 8).alias("weight"), r(F.col("l_extendedprice") / middle).alias("relative"))


@query(
    "frame_expression",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 1e-6 THEN (l_extendedprice - 0.5 * l_discount - 2.0 * l_tax) / l_quantity END
    * CASE (l_linenumber % 2) * 2 + l_orderkey % 2 WHEN 0 THEN 1.0 WHEN 1 THEN 1.1 WHEN 2 THEN 0.9 ELSE 1.05 END * 1.5 + 10 + 1e-9, 6) AS v FROM lineitem""",
)
def frame_expression(spark, sf_dir):
    pattern = stack.pattern_scale([1.0, 1.1, 0.9, 1.05], F.col("l_linenumber"), F.col("l_orderkey"))
    v = stack.expression(F.col("l_extendedprice"), [(0.5, F.col("l_discount")), (2.0, F.col("l_tax"))], F.col("l_quantity"), 1e-6, pattern, 1.5, None, 10.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(v).alias("v"))


@query(
    "exact_quantile_hot_group",
    "SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.9) + 1e-9, 4) AS p90 FROM lineitem GROUP BY 1",
)
def exact_quantile_hot_group(spark, sf_dir):
    out = stats.exact_quantile(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", 0.9)
    return out.select("l_linestatus", r("quantile", 4).alias("p90"))


@query(
    "super_luminance",
    """WITH c AS (SELECT l_returnflag, l_partkey, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
    q AS (SELECT c.l_returnflag, median(c.v / f.v) AS scale FROM c JOIN (SELECT l_partkey, v FROM c WHERE l_returnflag = 'N' AND v > 0) f USING (l_partkey) GROUP BY 1),
    d AS (SELECT l_returnflag, v - lag(v) OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS d FROM c),
    m AS (SELECT l_returnflag, median(d) AS med FROM d GROUP BY 1),
    n AS (SELECT l_returnflag, 1.4826 * median(abs(d - med)) / sqrt(2) AS noise FROM d JOIN m USING (l_returnflag) GROUP BY 1)
    SELECT l_returnflag, round(scale + 1e-9, 6) AS scale, round(noise + 1e-9, 3) AS noise, round(pow(scale / noise, 2) / sum(pow(scale / noise, 2)) OVER () + 1e-9, 6) AS weight FROM q JOIN n USING (l_returnflag)""",
)
def super_luminance(spark, sf_dir):
    from ..operators.network import super_channel

    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.avg("l_extendedprice").alias("v"))
    out = super_channel(cells, "l_returnflag", ["l_partkey"], "v", "N")
    return out.select("l_returnflag", r("scale").alias("scale"), r("noise", 3).alias("noise"), r("weight").alias("weight"))
