"""Nights, sessions and peers: event = observation, user = instrument, night = date of ts - 12 h."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats, windows
from .registry import query, r, table

NIGHT = "cast(ts - INTERVAL 12 HOUR AS DATE)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("night", windows.night(F.col("ts")))


@query("night_assignment", f"SELECT event_id, {NIGHT} AS night FROM events")
def night_assignment(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "night")


@query(
    "gap_blocks",
    f"""WITH e AS (SELECT event_id, user_id, ts, {NIGHT} AS night FROM events),
    g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id, night ORDER BY ts, event_id))
    SELECT event_id, night, cast(sum(new) OVER (PARTITION BY user_id, night ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM g""",
)
def gap_blocks(spark, sf_dir):
    return windows.gap_blocks(events(spark, sf_dir), ["user_id", "night"], "ts", 7200.0, "event_id").select("event_id", "night", "block")


@query(
    "session_blocks",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000 THEN 0 ELSE 1 END AS new FROM events),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM b GROUP BY user_id, k""",
)
def session_blocks(spark, sf_dir):
    out = windows.sessions(events(spark, sf_dir), ["user_id"], "ts")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query(
    "night_summary_rollup",
    f"""SELECT {NIGHT} AS night, event_type, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, count(*) FILTER (WHERE value > 100) AS strong FROM events GROUP BY ROLLUP (1, 2)""",
)
def night_summary_rollup(spark, sf_dir):
    out = events(spark, sf_dir).rollup("night", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("value") > 100).alias("strong"))
    return out.withColumn("mean", r("mean"))


@query(
    "night_baseline",
    f"""WITH e AS (SELECT event_id, event_type, {NIGHT} AS night, value FROM events),
    p AS (SELECT a.event_id, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY b.value) AS up, row_number() OVER (PARTITION BY a.event_id ORDER BY b.value DESC) AS down, count(*) OVER (PARTITION BY a.event_id) AS m
      FROM e a JOIN e b ON a.event_type = b.event_type AND a.night = b.night AND a.event_id <> b.event_id),
    s AS (SELECT event_id, quantile_cont(value, 0.5) FILTER (WHERE up <= greatest(1, ceil(round(m * 0.1, 9)))) AS lo, quantile_cont(value, 0.5) AS me, quantile_cont(value, 0.5) FILTER (WHERE down <= greatest(1, ceil(round(m * 0.1, 9)))) AS hi FROM p GROUP BY 1)
    SELECT e.event_id, round(lo + 1e-9, 6) AS peer_low, round(me + 1e-9, 6) AS peer_median, round(hi + 1e-9, 6) AS peer_high FROM e LEFT JOIN s USING (event_id)""",
)
def night_baseline(spark, sf_dir):
    out = windows.without_self(events(spark, sf_dir), ["event_type", "night"], "value")
    return out.select("event_id", *[r(c).alias(c) for c in ("peer_low", "peer_median", "peer_high")])


@query(
    "peer_scale_floor",
    f"""WITH e AS (SELECT user_id, {NIGHT} AS night, value FROM events),
    c AS (SELECT user_id, median(value) AS med FROM e GROUP BY 1), cm AS (SELECT user_id, 1.4826 * median(abs(value - med)) AS cohort FROM e JOIN c USING (user_id) GROUP BY 1),
    n AS (SELECT user_id, night, count(value) AS n, median(value) AS center FROM e GROUP BY 1, 2),
    nm AS (SELECT user_id, night, max(n) AS n, max(center) AS center, 1.4826 * median(abs(value - center)) AS madn FROM e JOIN n USING (user_id, night) GROUP BY 1, 2)
    SELECT user_id, night, n, round(center + 1e-9, 6) AS center, round(greatest(madn, 0.02 * abs(center), CASE WHEN n < 5 THEN cohort END) + 1e-9, 6) AS scale FROM nm JOIN cm USING (user_id)""",
)
def peer_scale_floor(spark, sf_dir):
    out = windows.peer_scale(events(spark, sf_dir), ["user_id"], "night", "value")
    return out.select("user_id", "night", "n", r("center").alias("center"), r("scale").alias("scale"))


@query(
    "theil_sen_user",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 3.6e9 AS x, value AS y FROM events),
    p AS (SELECT a.user_id, (b.y - a.y) / (b.x - a.x) AS s FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(b.x - a.x) >= 0.05 AND a.x <> b.x),
    m AS (SELECT user_id, count(*) AS pairs, median(s) AS slope FROM p GROUP BY 1)
    SELECT user_id, max(pairs) AS pairs, round(max(slope) + 1e-9, 6) AS slope, round(median(y - slope * x), 1) AS intercept FROM e JOIN m USING (user_id) GROUP BY 1""",
)
def theil_sen_user(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("x", F.unix_micros("ts") / 3.6e9)
    out = stats.theil_sen(rows, ["user_id"], "x", "value", "event_id", 0.05)
    return out.select("user_id", "pairs", r("slope").alias("slope"), F.round("intercept", 1).alias("intercept"))


@query(
    "low_envelope",
    f"""WITH e AS (SELECT {NIGHT} AS night, event_type, value, row_number() OVER (PARTITION BY {NIGHT}, event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY {NIGHT}, event_type) AS n FROM events)
    SELECT night, event_type, max(n) AS n, round(quantile_cont(value, 0.5) FILTER (WHERE k <= ceil(round(n * 0.1, 9))) + 1e-9, 6) AS envelope FROM e GROUP BY 1, 2""",
)
def low_envelope(spark, sf_dir):
    out = stats.envelope(events(spark, sf_dir), ["night", "event_type"], "value")
    return out.withColumn("envelope", r("envelope"))


EXTINCTION = f"""WITH e AS (SELECT event_id, user_id, {NIGHT} AS night, 1 + (event_id % 11) / 5.0 AS x, value / 100 AS y FROM events),
    p AS (SELECT (b.y - a.y) / (b.x - a.x) AS s FROM e a JOIN e b ON a.night = b.night AND a.event_id < b.event_id WHERE abs(b.x - a.x) >= 0.05),
    f AS (SELECT count(*) AS pairs, median(s) AS raw FROM p WHERE abs(s) <= 2.0),
    v AS (SELECT sum(c) AS valid, max(span) AS span FROM (SELECT count(*) AS c, max(x) - min(x) AS span FROM e GROUP BY night)),
    m AS (SELECT greatest(least(raw, 1.0), 0.0) AS slope, coalesce(valid >= 4 AND pairs >= 3 AND span >= 0.2, false) AND raw IS NOT NULL AS reliable FROM f, v),
    c AS (SELECT e.*, slope, reliable, y - coalesce(slope, 0) * (x - 1) AS corrected FROM e, m),
    k AS (SELECT night, corrected, row_number() OVER (PARTITION BY night ORDER BY corrected) AS r, count(*) OVER (PARTITION BY night) AS n FROM c),
    o AS (SELECT night, quantile_cont(corrected, 0.5) AS off FROM k WHERE r <= ceil(round(n * 0.1, 9)) GROUP BY 1)
    SELECT event_id, round(slope + 1e-9, 6) AS slope, reliable, round(corrected + 1e-9, 6) AS corrected, round(off + 1e-9, 6) AS night_offset, round(corrected - off + 1e-9, 6) AS residual FROM c JOIN o USING (night)"""


@query("extinction_envelope", EXTINCTION)
def extinction_envelope(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"x": 1 + (F.col("event_id") % 11) / 5.0, "y": F.col("value") / 100})
    out = windows.night_extinction(rows, "night", "x", "y", "event_id")
    return out.select("event_id", r("slope").alias("slope"), "reliable", *[r(c).alias(c) for c in ("corrected", "night_offset", "residual")])


@query(
    "topk_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 4",
)
def topk_per_group(spark, sf_dir):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return windows.top_k(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 4).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query(
    "reference_choice",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1""",
)
def reference_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    best = windows.best_row(rows, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "soft_guard",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_discount >= 0.05 AS soft, l_extendedprice AS v FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY soft DESC, v NULLS FIRST, l_orderkey * 10 + l_linenumber) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM a)
    SELECT l_orderkey, l_linenumber, soft AND k <= n - greatest(2, ceil(round(n * 0.5, 9))) AS dropped FROM b""",
)
def soft_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return windows.soft_guard(rows, ["l_suppkey"], F.col("l_discount") >= 0.05, "l_extendedprice", "tie").select("l_orderkey", "l_linenumber", "dropped")


@query(
    "score_z",
    """WITH s AS (SELECT o_custkey, o_orderkey, log10(o_totalprice) AS v FROM orders WHERE o_totalprice > 0), m AS (SELECT o_custkey, median(v) AS med FROM s GROUP BY 1),
    d AS (SELECT o_custkey, median(abs(v - med)) AS mad FROM s JOIN m USING (o_custkey) GROUP BY 1)
    SELECT o_orderkey, round((v - med) / greatest(1.4826 * mad, 0.05) + 1e-9, 6) AS score_z FROM s JOIN m USING (o_custkey) JOIN d USING (o_custkey)""",
)
def score_z(spark, sf_dir):
    out = windows.score_z(table(spark, sf_dir, "orders").where("o_totalprice > 0"), ["o_custkey"], "o_totalprice")
    return out.select("o_orderkey", r("score_z").alias("score_z"))


@query(
    "conversation_turns_window",
    """SELECT conv_id, turn, role, length(text) - lag(length(text)) OVER w AS longer, cast(count(*) FILTER (WHERE role = 'user') OVER w AS BIGINT) AS user_turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)""",
)
def conversation_turns_window(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.length("text").cast("long")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", (n - F.lag(n).over(order)).alias("longer"), F.count_if(F.col("role") == "user").over(upto).alias("user_turns"))
