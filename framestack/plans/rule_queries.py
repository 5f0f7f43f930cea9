"""Rule engine: channel = return flag and line status, frame = supplier; measured columns are made from sums of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping, rules
from .registry import dealt, query, r, table

FRAMES = """WITH f AS (SELECT l_returnflag AS channel, l_suppkey AS frame, count(*) AS stars, avg(l_extendedprice) AS sky, avg(l_quantity) / 10 AS fwhm, avg(l_discount) * 10 AS extinction, avg(l_tax) * 5 AS ellipticity FROM lineitem GROUP BY 1, 2),
c AS (SELECT channel, count(*) AS frames, count(*) FILTER (WHERE extinction < 0.5) AS clean_frames,
  CASE WHEN count(stars) >= 10 THEN quantile_cont(stars::DOUBLE, 0.9) ELSE max(stars) END AS sources_best, greatest(min(fwhm), quantile_cont(fwhm, 0.1)) AS fwhm_best,
  CASE WHEN count(sky) FILTER (WHERE extinction < 0.5) >= 3 THEN quantile_cont(sky, 0.5) FILTER (WHERE extinction < 0.5) END AS sky_clean FROM f GROUP BY 1)
"""


def frames(spark, sf_dir):
    """Means of a frame's lines, added in the order of the table's rows: thresholds on means then fall alike for any splits of the files."""
    lines = table(spark, sf_dir, "lineitem")
    channel, frame = F.col("l_returnflag").alias("channel"), F.col("l_suppkey").alias("frame")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")][0 if len(lines.inputFiles()) > 1 else 1 :]
    rows = lines.select(channel, frame, "l_extendedprice", "l_quantity", "l_discount", "l_tax", *place)
    rows = dealt(rows, lines.count(), "channel", "frame").sortWithinPartitions("channel", "frame", *[c for c in ("_file", "_row") if c in rows.columns])
    return rows.groupBy("channel", "frame").agg(
        F.count("*").alias("stars"), F.avg("l_extendedprice").alias("sky"), (F.avg("l_quantity") / 10).alias("fwhm"), (F.avg("l_discount") * 10).alias("extinction"), (F.avg("l_tax") * 5).alias("ellipticity")
    )


def channels(rows):
    return rules.channel_statistics(rows, ["channel"], F.col("extinction") < 0.5, "stars", "fwhm", "sky")


@query("channel_statistics", FRAMES + "SELECT channel, frames, clean_frames, round(sources_best + 1e-9, 4) AS sources_best, round(fwhm_best + 1e-9, 6) AS fwhm_best, round(sky_clean + 1e-9, 3) AS sky_clean FROM c")
def channel_statistics(spark, sf_dir):
    out = channels(frames(spark, sf_dir))
    return out.select("channel", "frames", "clean_frames", r("sources_best", 4).alias("sources_best"), r("fwhm_best").alias("fwhm_best"), r("sky_clean", 3).alias("sky_clean"))


@query(
    "absolute_flags",
    FRAMES
    + """, g AS (SELECT channel, frame, list_sort(list_filter([CASE WHEN sky / sky_clean >= 1.6 THEN 'SKY_BRIGHT' END, CASE WHEN sky / sky_clean >= 1.6 AND stars / sources_best <= 0.6 THEN 'SKY_BRIGHT_FEW_SOURCES' END,
    CASE WHEN stars / sources_best <= 0.6 AND stars / sources_best > 0.45 THEN 'SOURCES_LOW' END, CASE WHEN stars / sources_best <= 0.45 THEN 'SOURCES_VERY_LOW' END, CASE WHEN extinction >= 0.5 AND extinction < 1 THEN 'EXTINCTION' END,
    CASE WHEN extinction >= 1 THEN 'EXTINCTION_STRONG' END, CASE WHEN fwhm / fwhm_best >= 1.3 AND fwhm / fwhm_best < 1.6 THEN 'FWHM_LARGE' END, CASE WHEN fwhm / fwhm_best >= 1.6 THEN 'FWHM_VERY_LARGE' END,
    CASE WHEN ellipticity >= 0.3 THEN 'ELONGATED' END, CASE WHEN stars < 20 THEN 'FEW_STARS' END], lambda x: x IS NOT NULL)) AS f FROM f JOIN c USING (channel))
    SELECT channel, frame, array_to_string(f, ',') AS flags, CASE WHEN list_has_any(f, ['SKY_BRIGHT_FEW_SOURCES', 'SOURCES_VERY_LOW', 'EXTINCTION_STRONG', 'FWHM_VERY_LARGE', 'FEW_STARS']) THEN 'DROP' ELSE 'KEEP' END AS decision FROM g""",
)
def absolute_flags(spark, sf_dir):
    rows = frames(spark, sf_dir)
    met = rows.join(channels(rows), "channel")
    flags = rules.absolute_flags(*[F.col(c) for c in ("stars", "sources_best", "fwhm", "fwhm_best", "sky", "sky_clean", "extinction", "ellipticity", "stars")])
    return met.withColumn("f", flags).select("channel", "frame", F.array_join("f", ",").alias("flags"), rules.default_decision(F.col("f")).alias("decision"))


@query(
    "frame_scores",
    FRAMES
    + """SELECT channel, frame, round(score + 1e-9, 6) AS score, cast(row_number() OVER (PARTITION BY channel ORDER BY round(score + 1e-9, 6) DESC, frame) AS INTEGER) AS rank FROM (SELECT channel, frame,
    pow((1 - ellipticity) / (1.4826 * fwhm), 2) * pow(fwhm_best / fwhm, 2) * greatest(0, least(1, 1 - ellipticity)) * least(1, stars / max(stars) OVER (PARTITION BY channel)) AS score FROM f JOIN c USING (channel))""",
)
def frame_scores(spark, sf_dir):
    from pyspark.sql import Window

    rows = frames(spark, sf_dir)
    met = rows.join(channels(rows), "channel").withColumn("richest", F.max("stars").over(Window.partitionBy("channel")))
    score = rules.frame_score(1 - F.col("ellipticity"), F.col("fwhm"), F.col("fwhm_best"), F.col("fwhm"), F.col("ellipticity"), F.col("stars"), F.col("richest"))
    out = met.select("channel", "frame", r(score).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.col("score").desc(), "frame")))


@query(
    "suspect_blocks",
    """WITH b AS (SELECT l_returnflag, l_suppkey, count(*) AS frames, median(l_discount * 10) AS mv, count(*) FILTER (WHERE l_tax >= 0.06) / count(*)::DOUBLE AS ms FROM lineitem GROUP BY 1, 2),
    k AS (SELECT *, (mv < 0.36 OR ms >= 0.5) AS bad, row_number() OVER (PARTITION BY l_returnflag ORDER BY CASE WHEN mv < 0.36 OR ms >= 0.5 THEN 0 ELSE 1 END, mv NULLS FIRST, l_suppkey) AS k FROM b)
    SELECT l_returnflag, l_suppkey, frames, round(mv + 1e-9, 6) AS median_value, round(ms + 1e-9, 6) AS marked_share, bad AND k <= 4 AS suspect FROM k""",
)
def suspect_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_discount") * 10)
    out = rules.suspect_blocks(rows, ["l_returnflag"], "l_suppkey", "v", F.col("l_tax") >= 0.06)
    return out.select("l_returnflag", "l_suppkey", "frames", r("median_value").alias("median_value"), r("marked_share").alias("marked_share"), "suspect")


@query(
    "counterfactual_harmful",
    """WITH d AS (SELECT l_returnflag, l_suppkey, avg(l_discount) AS delta, avg(l_discount) - 0.002 AS low, count(*) AS tiles FROM lineitem GROUP BY 1, 2),
    m AS (SELECT l_returnflag, median(delta) AS med FROM d GROUP BY 1), s AS (SELECT l_returnflag, 1.4826 * median(abs(delta - med)) AS sd FROM d JOIN m USING (l_returnflag) GROUP BY 1)
    SELECT l_returnflag, l_suppkey, tiles >= 16 AND low > 0.005 AND delta > med + 3 * sd AS harmful FROM d JOIN m USING (l_returnflag) JOIN s USING (l_returnflag)""",
)
def counterfactual_harmful(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("delta"), (F.avg("l_discount") - 0.002).alias("low"), F.count("*").alias("tiles"))
    return rules.harmful(rows, ["l_returnflag"], "delta", "low", "tiles").select("l_returnflag", "l_suppkey", "harmful")


@query("group_share_guard", "SELECT l_orderkey, l_linenumber, l_discount >= 0.06 AND count(*) FILTER (WHERE l_discount >= 0.06) OVER (PARTITION BY l_orderkey) / (count(*) OVER (PARTITION BY l_orderkey))::DOUBLE <= 0.5 AS held FROM lineitem")
def group_share_guard(spark, sf_dir):
    return rules.group_share_guard(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_discount") >= 0.06).select("l_orderkey", "l_linenumber", "held")


@query(
    "admission_routes",
    """WITH l AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'REJECT_QUALITY' WHEN toxic = 1 THEN 'REVIEW' ELSE 'KEEP' END AS decision FROM labels)
    SELECT 'legacy' AS route, count(*) AS n FROM l WHERE decision NOT LIKE 'REJECT%' UNION ALL SELECT 'unattended', count(*) FROM l WHERE decision = 'KEEP' UNION ALL SELECT 'explicit', count(*) FROM l WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""",
)
def admission_routes(spark, sf_dir):
    decision = F.when(F.col("quality") == 0, "REJECT_QUALITY").when(F.col("toxic") == 1, "REVIEW").otherwise("KEEP")
    lights = table(spark, sf_dir, "labels").select("doc_id", decision.alias("decision"))
    approved = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "KEEP").otherwise("DROP").alias("decision"))
    out = [rules.admitted(lights, "doc_id", name, approved).agg(F.count("*").alias("n")).select(F.lit(name).alias("route"), "n") for name in ("legacy", "unattended", "explicit")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "relaxed_candidates",
    """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 0 WHEN l_discount >= 0.04 THEN 1 WHEN l_discount >= 0 THEN 2 END AS level FROM lineitem)
    SELECT l_orderkey, l_linenumber, level FROM l WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY l_orderkey)""",
)
def relaxed_candidates(spark, sf_dir):
    d = F.col("l_discount")
    return rules.relaxed_candidates(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [d >= 0.08, d >= 0.04, d >= 0]).select("l_orderkey", "l_linenumber", "level")


@query(
    "tolerance_warnings",
    "SELECT p_brand, max(p_retailprice) - min(p_retailprice) AS spread, count(DISTINCT p_type) AS settings FROM part GROUP BY 1 HAVING max(p_retailprice) - min(p_retailprice) > 500 OR count(DISTINCT p_type) > 1",
)
def tolerance_warnings(spark, sf_dir):
    return grouping.spread_warnings(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_type", 500.0)


@query("exposure_split")
def exposure_split(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("exposure", F.col("p_size").cast("double"))
    return grouping.tolerance_split(rows, ["p_brand"], "exposure", 2.0).select("p_partkey", "split")


@query("cfa_expand", "SELECT p_partkey, unnest(CASE WHEN p_size % 2 = 0 THEN ['R', 'G', 'B'] ELSE [p_brand] END) AS color FROM part")
def cfa_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("color"))
    return grouping.expand_colors(rows, "color", F.col("p_size") % 2 == 0).select("p_partkey", "color")


@query("group_identity", """SELECT substr(sha256('["' || p_brand || '","' || cast(p_size AS VARCHAR) || '"]'), 1, 12) AS group_id, count(*) AS n FROM part GROUP BY 1""")
def group_identity(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(grouping.group_id(F.col("p_brand"), F.col("p_size")).alias("group_id")).agg(F.count("*").alias("n"))


@query(
    "orientation_coherence",
    """SELECT label, round(sqrt(pow(sum(w * cos(2 * t)), 2) + pow(sum(w * sin(2 * t)), 2)) / sum(w) + 1e-9, 6) AS coherence FROM (SELECT label, atan2(cast(embedding[2] AS DOUBLE), cast(embedding[1] AS DOUBLE)) AS t, abs(cast(embedding[3] AS DOUBLE)) AS w FROM embeddings) GROUP BY 1""",
)
def orientation_coherence(spark, sf_dir):
    from ..operators.stats import coherence

    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(r(coherence(F.atan2(e(1), e(0)), F.abs(e(2)))).alias("coherence"))
