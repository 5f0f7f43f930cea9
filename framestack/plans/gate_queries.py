"""The whole quality gate and the flags behind it: a frame = an order, a cohort = an order priority, a night = a month."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blink, gate
from .registry import query, r, table

#: SQL of the measured columns of a frame, made of order keys and sums of lines; the same text serves Spark and the oracle.
MEASURES = {
    "cohort": "o_orderpriority",
    "night": "CASE WHEN k % 97 <> 0 THEN substr(cast(o_orderdate AS STRING), 1, 7) END",
    "path": "cast(k AS STRING)",
    "reference": "cast(ref AS STRING)",
    "role": "CASE WHEN k % 211 = 0 THEN 'DARK' ELSE 'LIGHT' END",
    "status": "CASE WHEN k % 223 = 0 THEN NULL WHEN k % 227 = 0 THEN 'FAILED' ELSE 'MEASURED' END",
    "error_code": "CAST(NULL AS STRING)",
    "identity": "CASE WHEN k % 229 <> 0 THEN 'a' END",
    "result_identity": "CASE WHEN k % 233 = 0 THEN 'b' ELSE 'a' END",
    "finite_fraction": "CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN 1.5 WHEN k % 107 = 0 THEN 0.9 WHEN k % 53 = 0 THEN 0.99 ELSE 1.0 END",
    "dynamic_range": "CASE WHEN k % 109 = 0 THEN NULL WHEN k % 113 = 0 THEN 0.0 ELSE 500.0 END",
    "image_median": "1000.0 + 300.0 * tax + CASE WHEN k % 41 = 0 THEN 900.0 ELSE 0.0 END",
    "image_mad": "20.0 + 10.0 * disc",
    "texture": "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 47 = 0 THEN 60.0 ELSE 20.0 + 8.0 * tax END",
    "source_count": "CASE WHEN k % 127 = 0 THEN NULL WHEN k % 131 = 0 THEN 12.0 ELSE 400.0 + 3.0 * qty - CASE WHEN k % 37 = 0 THEN 250.0 ELSE 0.0 END END",
    "registration_ok": "k % 59 <> 0",
    "matched_stars": "CAST(CASE WHEN k % 61 = 0 THEN 12 ELSE 100 + k % 90 END AS BIGINT)",
    "match_fraction": "0.3 + (k % 10) / 20.0",
    "rms": "CASE WHEN k % 67 = 0 THEN NULL ELSE 0.4 + (k % 7) / 5.0 END",
    "overlap": "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 71 = 0 THEN 0.4 ELSE 0.95 END",
    "field_coverage": "CASE WHEN k % 137 = 0 THEN 0.5 ELSE 0.97 END",
    "transparency": "CASE WHEN k % 139 = 0 THEN NULL ELSE pow(10.0, -0.4 * (0.25 * (k % 11) / 5.0 + CASE WHEN k % 29 = 0 THEN 0.6 WHEN k % 31 = 0 THEN 1.8 ELSE tax END)) END",
    "airmass": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 1.0 + (k % 11) / 5.0 END",
    "extra_extinction": "CASE WHEN k % 2 = 0 THEN tax * 5.0 END",
    "dimming": "CASE WHEN k % 4 = 0 THEN NULL ELSE disc * 2.5 END",
    "completeness": "CASE WHEN k % 19 = 0 THEN 0.4 + disc * 3.0 ELSE 0.95 END",
    "source_ratio": "0.5 + qty / 100.0",
    "shape_stars": "CAST(CASE WHEN k % 149 = 0 THEN 10 ELSE 40 END AS BIGINT)",
    "hfr": "CASE WHEN k % 3 = 1 THEN NULL ELSE 2.0 + disc + CASE WHEN k % 43 = 0 THEN 0.9 ELSE 0.0 END END",
    "fwhm": "3.0 + disc + CASE WHEN k % 43 = 0 THEN 0.8 WHEN k % 83 = 0 THEN 1.6 ELSE 0.0 END",
    "ellipticity": "0.1 + tax + CASE WHEN k % 23 = 0 THEN 0.25 WHEN k % 89 = 0 THEN 0.5 ELSE 0.0 END",
    "ellipticity_p90": "0.3 + tax + CASE WHEN k % 73 = 0 THEN 0.3 ELSE 0.0 END",
    "elongated": "CASE WHEN k % 89 = 0 THEN 0.8 ELSE 0.1 END",
    "coherence": "CASE WHEN k % 89 = 0 THEN 0.9 WHEN k % 2 = 0 THEN 0.1 ELSE 0.5 END",
    "fragmented": "k % 151 = 0",
    "missing_area": "CASE WHEN k % 79 = 0 THEN 0.35 WHEN k % 157 = 0 THEN 0.2 WHEN k % 163 = 0 THEN 0.08 ELSE 0.01 END",
    "missing_density": "CASE WHEN k % 157 = 0 THEN 0.1 WHEN k % 79 = 0 OR k % 163 = 0 THEN 0.3 ELSE 0.9 END",
    "boundary_support": "CASE WHEN k % 157 = 0 OR k % 163 = 0 THEN 0.7 ELSE 0.2 END",
    "background_support": "CASE WHEN k % 79 = 0 OR k % 157 = 0 THEN 0.6 ELSE 0.3 END",
    "gradient": "CASE WHEN k % 7 = 0 THEN NULL ELSE 10.0 + 200.0 * disc END",
    "background_shape": "CASE WHEN k % 17 = 0 THEN 0.6 ELSE 0.2 END",
}


def _duck(text: str) -> str:
    return text.replace("STRING", "VARCHAR").replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)")


def frames(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_tax").alias("tax"), F.max("l_discount").alias("disc"), F.max("l_quantity").alias("qty"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", "o_orderdate")
    first = orders.groupBy("o_orderpriority").agg(F.min("k").alias("ref"))
    rows = orders.join(lines, "k").join(first, "o_orderpriority")
    return rows.select(*[F.expr(sql).alias(name) for name, sql in MEASURES.items()])


_SERIES = {"bg": "image_median", "ns": "noise", "hf": "hfr", "fw": "fwhm", "el": "ellipticity"}


def _others(s: str, v: str) -> str:
    """Median, spread and tenths of the night's other frames, by joining each frame with them."""
    return f"""{s}_o AS (SELECT a.path, b.{v} AS v, row_number() OVER (PARTITION BY a.path ORDER BY b.{v}) AS r, count(*) OVER (PARTITION BY a.path) AS n FROM f a JOIN f b ON a.cohort = b.cohort AND a.night = b.night AND a.path <> b.path WHERE a.{v} IS NOT NULL AND b.{v} IS NOT NULL),
    {s}_m AS (SELECT path, median(v) AS c, max(n) AS n, median(v) FILTER (WHERE r <= ceil(round(n * 0.1, 9))) AS low, median(v) FILTER (WHERE r > n - ceil(round(n * 0.1, 9))) AS high FROM {s}_o GROUP BY 1),
    {s}_d AS (SELECT path, 1.4826 * median(abs(v - c)) AS s FROM {s}_o JOIN {s}_m USING (path) GROUP BY 1),
    {s}_w AS (SELECT cohort, CASE WHEN count({v}) >= 2 THEN 1.4826 * median(abs({v} - mid)) END AS w FROM f JOIN (SELECT cohort, median({v}) AS mid FROM f GROUP BY 1) USING (cohort) GROUP BY 1),
    {s} AS (SELECT path, c, low, high, CASE WHEN x > 1e-9 THEN x ELSE greatest(abs(c) * 0.02, 1e-9) END AS s FROM (SELECT f.path, c, low, high, greatest(s, abs(c) * 0.02, CASE WHEN n < 5 THEN w END) AS x FROM f JOIN {s}_m USING (path) JOIN {s}_d USING (path) JOIN {s}_w USING (cohort)))"""


def _low(s: str, v: str) -> str:
    return f"""{s}_n AS (SELECT cohort, night, median(v) FILTER (WHERE r <= ceil(round(n * 0.1, 9))) AS low FROM (SELECT cohort, night, {v} AS v, row_number() OVER (PARTITION BY cohort, night ORDER BY {v}) AS r, count(*) OVER (PARTITION BY cohort, night) AS n FROM f WHERE night IS NOT NULL AND {v} IS NOT NULL) GROUP BY 1, 2),
    {s}_b AS (SELECT cohort, CASE WHEN count(*) >= 2 THEN min(low) END AS best FROM {s}_n GROUP BY 1)"""


_FRAMES = f"""l AS (SELECT l_orderkey AS k, max(l_tax) AS tax, max(l_discount) AS disc, max(l_quantity) AS qty FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS k, o_orderpriority, o_orderdate, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS ref FROM orders),
    f0 AS (SELECT {", ".join(f"{_duck(sql)} AS {name}" for name, sql in MEASURES.items())} FROM o JOIN l USING (k)),
    f AS (SELECT *, coalesce(nullif(texture, 0), image_mad) AS noise, CASE WHEN transparency > 0 THEN -2.5 * log10(transparency) END AS ext FROM f0)"""
_RULES = [
    ("IDENTITY", 4, "MEASUREMENT_MISSING", "status IS NULL"),
    ("IDENTITY", 4, "MEASUREMENT_FAILED", "status <> 'MEASURED'"),
    ("IDENTITY", 4, "IDENTITY_MISSING", "status IS NOT NULL AND identity IS NULL"),
    ("IDENTITY", 4, "IDENTITY_MISMATCH", "status IS NOT NULL AND identity <> result_identity"),
    ("ROLE", 4, "NOT_A_LIGHT_FRAME", "status IS NOT NULL AND role <> 'LIGHT'"),
    ("PIXELS", 2, "FINITE_FRACTION_MISSING", "status IS NOT NULL AND finite_fraction IS NULL"),
    ("PIXELS", 4, "FINITE_FRACTION_INVALID", "status IS NOT NULL AND NOT finite_fraction BETWEEN 0 AND 1"),
    ("PIXELS", 4, "FINITE_FRACTION_HARD", "status IS NOT NULL AND finite_fraction >= 0 AND finite_fraction < 0.95"),
    ("PIXELS", 2, "FINITE_FRACTION_REVIEW", "status IS NOT NULL AND finite_fraction >= 0.95 AND finite_fraction < 0.999"),
    ("PIXELS", 2, "DYNAMIC_RANGE_MISSING", "status IS NOT NULL AND dynamic_range IS NULL"),
    ("PIXELS", 4, "NEAR_CONSTANT_IMAGE", "status IS NOT NULL AND dynamic_range <= greatest(1e-8, abs(image_median) * 1e-8)"),
    ("METADATA", 2, "NIGHT_UNRESOLVED", "night IS NULL"),
    ("PROVENANCE", 2, "INSUFFICIENT_COHORT", "cohort_size < 8"),
    ("PROVENANCE", 2, "INSUFFICIENT_NIGHT_BASELINE", "night IS NOT NULL AND night_size < 3"),
    ("REGISTRATION", 2, "REFERENCE_NOT_CONNECTED", "path = reference AND peer IS NULL"),
    ("REGISTRATION", 2, "REGISTRATION_REVIEW", "NOT registered"),
    ("REGISTRATION", 2, "COMMON_FOOTPRINT_REVIEW", "NOT coalesce(overlap IS NULL AND e.ok AND e.ms >= 30 AND e.mf >= 0.75, false) AND (overlap IS NULL OR overlap < 0.5)"),
    ("REGISTRATION", 4, "FIELD_OFFSET_HARD", "field_coverage < 0.85"),
    ("TRANSPARENCY", 3, "TEMPORAL_EXTINCTION_STRONG", "excess >= 1.5"),
    ("TRANSPARENCY", 0, "TEMPORAL_EXTINCTION_INFO", "excess >= 0.35 AND excess < 1.5"),
    ("TRANSPARENCY", 2, "NIGHT_ZEROPOINT_SHIFT_REVIEW", "reliable AND off - best_off >= 0.5"),
    ("CONSENSUS", 3, "SPATIAL_DIMMING_STRONG", "dimming >= 0.45"),
    ("CONSENSUS", 2, "SPATIAL_DIMMING_REVIEW", "dimming >= 0.18 AND dimming < 0.45"),
    ("CONSENSUS", 3, "SOURCE_RETENTION_STRONG", "retention <= 0.45"),
    ("CONSENSUS", 2, "SOURCE_RETENTION_REVIEW", "retention > 0.45 AND retention <= 0.7"),
    ("CONSENSUS", 2, "ABSOLUTE_LOW_SOURCE_COUNT", "source_count < 20"),
    ("CONSENSUS", 2, "SOURCE_COUNT_MISSING", "source_count IS NULL"),
    ("BACKGROUND", 3, "BACKGROUND_STRONG", "abs(bz) >= 6 AND abs(br - 1) >= 0.5"),
    ("BACKGROUND", 2, "BACKGROUND_REVIEW", "abs(bz) >= 4 AND abs(br - 1) >= 0.25 AND NOT (abs(bz) >= 6 AND abs(br - 1) >= 0.5)"),
    ("BACKGROUND", 2, "NOISE_REVIEW", "(nr <= 0.55 OR nr >= 1.8) AND abs(nz) >= 4"),
    ("MORPHOLOGY", 2, "MORPHOLOGY_SAMPLE_REVIEW", "shape_stars < 15"),
    ("MORPHOLOGY", 2, "FOCUS_SEEING_REVIEW", "(coalesce(hr >= 1.12 AND hd >= 0.25 AND hz >= 3.5, false) AND coalesce(fr >= 1.12 AND fd >= 0.25 AND fz >= 3.5, false)) OR coalesce(hr >= 1.3, false) OR coalesce(fr >= 1.3, false)"),
    ("MORPHOLOGY", 2, "NIGHT_FOCUS_SHIFT_REVIEW", "coalesce(nhr >= 1.15 AND nfr >= 1.12, false) OR coalesce(nfr >= 1.3 AND nfd >= 0.25, false)"),
    ("MORPHOLOGY", 4, "FRAGMENTED_TRAILING_HARD", "fragmented"),
    ("MORPHOLOGY", 4, "COHERENT_TRAILING_HARD", "smear"),
    ("MORPHOLOGY", 0, "SHARED_ELONGATION_INFO", "NOT smear AND longish AND optical"),
    ("MORPHOLOGY", 2, "TRAILING_REVIEW", "NOT smear AND longish AND NOT optical"),
    ("OCCLUSION", 4, "OCCLUSION_HARD", "blocked"),
    ("OCCLUSION", 2, "OCCLUSION_REVIEW", "NOT blocked AND missing_area >= 0.05 AND (missing_density <= 0.35)::INT + (boundary_support >= 0.5)::INT + (background_support >= 0.5)::INT >= 2"),
]
GATE = f"""WITH {_FRAMES},
    {", ".join(_others(s, v) for s, v in (_SERIES | {"sc": "source_count"}).items())}, {_low("nh", "hfr")}, {_low("nf", "fwhm")},
    x AS (SELECT cohort, night, path, airmass, ext FROM f WHERE airmass > 0 AND ext IS NOT NULL AND night IS NOT NULL),
    ps AS (SELECT cohort, (b.ext - a.ext) / (b.airmass - a.airmass) AS s FROM x a JOIN x b USING (cohort, night) WHERE a.path < b.path AND abs(b.airmass - a.airmass) >= 0.05),
    fit AS (SELECT cohort, count(*) AS pairs, median(s) AS raw FROM ps WHERE abs(s) <= 2 GROUP BY 1),
    sp AS (SELECT cohort, sum(k) AS valid, max(CASE WHEN k > 1 THEN span END) AS span FROM (SELECT cohort, night, count(*) AS k, max(airmass) - min(airmass) AS span FROM x GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT cohort, least(greatest(raw, 0.0), 1.0) AS slope, coalesce(valid >= 4 AND pairs >= 3 AND span >= 0.2 AND raw BETWEEN 0 AND 1, false) AS reliable FROM sp LEFT JOIN fit USING (cohort)),
    fl AS (SELECT x.*, ext - slope * (airmass - 1) AS flat FROM x JOIN m USING (cohort) WHERE slope IS NOT NULL),
    ofs AS (SELECT cohort, night, median(flat) FILTER (WHERE r <= ceil(round(n * 0.1, 9))) AS off FROM (SELECT *, row_number() OVER (PARTITION BY cohort, night ORDER BY flat) AS r, count(*) OVER (PARTITION BY cohort, night) AS n FROM fl) GROUP BY 1, 2),
    bo AS (SELECT cohort, CASE WHEN count(*) >= 2 THEN min(off) END AS best_off FROM ofs GROUP BY 1),
    cs AS (SELECT cohort, count(*) AS cohort_size, CASE WHEN count(ext) >= 4 THEN quantile_cont(ext, 0.05) END AS clear_zero FROM f GROUP BY 1),
    ed AS (SELECT cohort, reference AS path, arg_max(struct_pack(ok := registration_ok, ms := matched_stars, mf := match_fraction, rms := rms), struct_pack(a := matched_stars, b := match_fraction, c := -coalesce(rms, 'inf'::DOUBLE))) AS peer FROM f WHERE registration_ok AND path <> reference GROUP BY 1, 2),
    h AS (SELECT f.*, cohort_size, clear_zero, count(*) OVER (PARTITION BY f.cohort, f.night) AS night_size, ed.peer,
        CASE WHEN f.path = f.reference AND ed.peer IS NOT NULL THEN ed.peer ELSE struct_pack(ok := f.registration_ok, ms := f.matched_stars, mf := f.match_fraction, rms := f.rms) END AS e,
        coalesce(reliable, false) AS reliable, off, best_off, flat - off AS residual, rf.ref_night, sc.high AS src_high,
        image_median / bg.c AS br, (image_median - bg.c) / bg.s AS bz, f.noise / ns.c AS nr, (f.noise - ns.c) / ns.s AS nz, f.hfr / hf.low AS hr, f.hfr - hf.low AS hd, (f.hfr - hf.low) / hf.s AS hz,
        f.fwhm / fw.low AS fr, f.fwhm - fw.low AS fd, (f.fwhm - fw.low) / fw.s AS fz, CASE WHEN nh_b.best IS NOT NULL THEN nh_n.low / greatest(nh_b.best, 1e-9) END AS nhr, CASE WHEN nf_b.best IS NOT NULL THEN nf_n.low / greatest(nf_b.best, 1e-9) END AS nfr, nf_n.low - nf_b.best AS nfd,
        CASE WHEN el.c IS NOT NULL THEN f.ellipticity / greatest(el.c, 1e-6) END AS er
      FROM f JOIN cs USING (cohort) LEFT JOIN ed ON ed.cohort = f.cohort AND ed.path = f.path LEFT JOIN m ON m.cohort = f.cohort LEFT JOIN ofs ON ofs.cohort = f.cohort AND ofs.night = f.night LEFT JOIN bo ON bo.cohort = f.cohort LEFT JOIN (SELECT path AS fpath, flat FROM fl) fl ON fl.fpath = f.path
      LEFT JOIN (SELECT path AS rpath, night AS ref_night FROM f) rf ON rf.rpath = f.reference LEFT JOIN sc ON sc.path = f.path LEFT JOIN bg ON bg.path = f.path LEFT JOIN ns ON ns.path = f.path LEFT JOIN hf ON hf.path = f.path LEFT JOIN fw ON fw.path = f.path LEFT JOIN el ON el.path = f.path
      LEFT JOIN nh_n ON nh_n.cohort = f.cohort AND nh_n.night = f.night LEFT JOIN nh_b ON nh_b.cohort = f.cohort LEFT JOIN nf_n ON nf_n.cohort = f.cohort AND nf_n.night = f.night LEFT JOIN nf_b ON nf_b.cohort = f.cohort),
    g AS (SELECT *, coalesce(e.ok AND e.ms >= 30 AND e.mf >= 0.25 AND e.rms <= 1.5, false) AS registered, reliable AND residual IS NOT NULL AS nightly,
        CASE WHEN reliable AND residual IS NOT NULL THEN residual ELSE coalesce(extra_extinction, ext - clear_zero) END AS excess,
        NOT (reliable AND residual IS NOT NULL) AND extra_extinction IS NULL AS uncorrected, reliable AND residual IS NOT NULL AND residual < 0.35 AS explained,
        coalesce(shape_stars >= 30 AND ellipticity >= 0.45 AND elongated >= 0.6 AND coherence >= 0.75 AND er >= 1.5, false) AS smear, (ellipticity >= 0.3 OR ellipticity_p90 >= 0.55) AS longish,
        coalesce(coherence < 0.25 AND er < 1.2 AND ellipticity < 0.45, false) AS optical,
        (missing_area >= 0.15 AND missing_density <= 0.15 AND boundary_support >= 0.65 AND background_support >= 0.5) OR (missing_area >= 0.3 AND missing_density <= 0.35 AND background_support >= 0.5) AS blocked FROM h),
    q AS (SELECT *, least(completeness, CASE WHEN NOT explained AND coalesce(ref_night = night, false) THEN source_ratio END, CASE WHEN NOT explained THEN source_count / src_high END) AS retention FROM g),
    v AS ({" UNION ALL ".join(f"SELECT path, '{family}' AS fam, {rank} AS sev, 'GATE_{code}' AS code FROM q WHERE {rule}" for family, rank, code, rule in _RULES)}),
    w1 AS (SELECT path, fam, max(struct_pack(sev := sev, code := code)) AS t FROM v GROUP BY 1, 2),
    thin AS (SELECT q.path, excess >= 0.45 AND NOT uncorrected AS strong FROM q LEFT JOIN w1 ON w1.path = q.path AND fam = 'BACKGROUND' WHERE excess >= 0.35 AND excess < 1.5 AND (coalesce(dimming >= 0.18, false) OR coalesce(t.sev >= 2, false))),
    w2 AS (SELECT path, fam, max(t) AS t FROM (SELECT * FROM w1 UNION ALL SELECT path, 'TRANSPARENCY', struct_pack(sev := CASE WHEN strong THEN 3 ELSE 2 END, code := CASE WHEN strong THEN 'GATE_TEMPORAL_EXTINCTION_STRONG' ELSE 'GATE_TEMPORAL_EXTINCTION_REVIEW' END) FROM thin) GROUP BY 1, 2),
    cloud AS (SELECT path FROM w2 JOIN q USING (path) WHERE t.sev >= 2 AND registered AND cohort_size >= 8 AND (fam = 'BACKGROUND' OR (fam = 'TRANSPARENCY' AND t.code LIKE 'GATE_TEMPORAL%') OR (fam = 'CONSENSUS' AND (t.code LIKE 'GATE_SPATIAL%' OR t.code LIKE 'GATE_SOURCE_RETENTION%'))) GROUP BY 1 HAVING count(*) >= 2 AND max(t.sev) >= 3),
    w AS (SELECT path, fam, max(t) AS t FROM (SELECT * FROM w2 UNION ALL SELECT path, 'TRANSPARENCY', struct_pack(sev := 4, code := 'GATE_MULTI_FAMILY_CLOUD_HARD') FROM cloud) GROUP BY 1, 2),
    verdict AS (SELECT q.path, coalesce(string_agg(t.code, ',' ORDER BY t.code), '') AS codes, CASE WHEN max(t.sev) >= 4 THEN 'HARD_FAIL' WHEN max(t.sev) >= 2 THEN 'REVIEW' ELSE 'PASS' END AS disposition FROM q LEFT JOIN w USING (path) GROUP BY 1)
"""


@query("gate_family_max", GATE + "SELECT path, codes, disposition FROM verdict")
def gate_family_max(spark, sf_dir):
    out = gate.evaluate(frames(spark, sf_dir))
    return out.select("path", F.array_join(F.array_sort("gate_codes"), ",").alias("codes"), "disposition")


@query("gate_summary", GATE + "SELECT cohort, disposition, count(*) AS n FROM verdict JOIN f USING (path) GROUP BY 1, 2")
def gate_summary(spark, sf_dir):
    return gate.evaluate(frames(spark, sf_dir)).groupBy("cohort", "disposition").agg(F.count("*").alias("n"))


def judged(spark, sf_dir):
    rows = frames(spark, sf_dir).select("cohort", "night", "path", "source_count", "fwhm", F.col("image_median").alias("sky"), "extra_extinction", "registration_ok", "transparency", "gradient", "background_shape", "ellipticity", "finite_fraction", "fragmented")
    # The gate's verdict is an input here; these findings of one frame stand for it.
    codes = F.array_compact(F.array(F.when(F.col("fragmented"), "GATE_FRAGMENTED_TRAILING_HARD"), F.when(F.col("finite_fraction").isNull(), "GATE_FINITE_FRACTION_MISSING"), F.when(~F.col("registration_ok"), "GATE_REGISTRATION_REVIEW"), F.when(F.col("source_count") < 350, "GATE_SOURCE_RETENTION_REVIEW")))
    return rows.select(F.col("cohort").alias("channel"), "night", "path", F.coalesce(F.col("source_count"), F.lit(0.0)).cast("long").alias("stars"), "fwhm", "sky", F.col("extra_extinction").alias("extinction"), "registration_ok", "transparency", "gradient", "background_shape", "ellipticity", codes.alias("gate_codes"), F.when(F.col("fragmented"), "HARD_FAIL").otherwise("PASS").alias("disposition"))


BLINK = f"""WITH {_FRAMES},
    j AS (SELECT cohort AS channel, night, path, CAST(trunc(coalesce(source_count, 0)) AS BIGINT) AS stars, fwhm, image_median AS sky, extra_extinction AS extinction, registration_ok, transparency, gradient, background_shape, ellipticity, fragmented, finite_fraction, source_count FROM f),
    b AS (SELECT channel, count(*) AS frames, CASE WHEN count(*) FILTER (WHERE NOT fragmented AND stars > 0) >= 10 THEN quantile_cont(stars::DOUBLE, 0.9) FILTER (WHERE NOT fragmented AND stars > 0) ELSE max(stars) FILTER (WHERE NOT fragmented AND stars > 0) END AS sources_best,
      greatest(min(fwhm) FILTER (WHERE NOT fragmented), quantile_cont(fwhm, 0.1) FILTER (WHERE NOT fragmented)) AS fwhm_best FROM j GROUP BY 1),
    k AS (SELECT j.*, NOT fragmented AND registration_ok AND coalesce(extinction < 0.35, false) AND stars / sources_best >= 0.6 AS ok FROM j JOIN b USING (channel)),
    c AS (SELECT channel, count(*) FILTER (WHERE ok) AS clean_frames, CASE WHEN count(*) FILTER (WHERE ok) >= 3 THEN median(sky) FILTER (WHERE ok) END AS sky_clean, CASE WHEN count(gradient / transparency) FILTER (WHERE ok) >= 3 THEN median(gradient / transparency) FILTER (WHERE ok) END AS gradient_clean FROM k GROUP BY 1),
    z AS (SELECT j.*, frames, clean_frames, sources_best, fwhm_best, sky_clean, gradient_clean, sky / sky_clean AS sky_ratio, stars / sources_best AS source_ratio, fwhm / fwhm_best AS fwhm_ratio, gradient / transparency / gradient_clean AS gr FROM j JOIN b USING (channel) JOIN c USING (channel)),
    fl AS (SELECT path, 'BLINK_SKY_BRIGHT' AS code, CASE WHEN coalesce(source_ratio <= 0.6, false) THEN 'EXCLUDE' ELSE 'ATTENTION' END AS sev FROM z WHERE sky_ratio >= 1.6
      UNION ALL SELECT path, 'BLINK_SOURCES_LOW', CASE WHEN source_ratio <= 0.45 THEN 'EXCLUDE' ELSE 'ATTENTION' END FROM z WHERE source_ratio <= 0.6
      UNION ALL SELECT path, 'BLINK_SOURCES_LOW', 'ATTENTION' FROM z WHERE source_count < 350 AND NOT coalesce(source_ratio <= 0.6, false)
      UNION ALL SELECT path, 'BLINK_EXTINCTION', CASE WHEN extinction >= 1 THEN 'EXCLUDE' ELSE 'ATTENTION' END FROM z WHERE extinction >= 0.5
      UNION ALL SELECT path, 'BLINK_BACKGROUND_SHAPE', 'ATTENTION' FROM z WHERE background_shape >= 0.5
      UNION ALL SELECT path, 'BLINK_GRADIENT_AMPLITUDE', CASE WHEN gr >= 3 THEN 'EXCLUDE' ELSE 'ATTENTION' END FROM z WHERE gr >= 2
      UNION ALL SELECT path, 'BLINK_FWHM_WIDE', CASE WHEN fwhm_ratio >= 1.6 THEN 'EXCLUDE' ELSE 'ATTENTION' END FROM z WHERE fwhm_ratio >= 1.3
      UNION ALL SELECT path, 'BLINK_STARS_ELONGATED', 'ATTENTION' FROM z WHERE ellipticity >= 0.3
      UNION ALL SELECT path, 'BLINK_UNREGISTRABLE', 'EXCLUDE' FROM z WHERE NOT registration_ok
      UNION ALL SELECT path, 'BLINK_FEW_STARS', 'EXCLUDE' FROM z WHERE stars < 20
      UNION ALL SELECT path, 'BLINK_TRAILING', 'EXCLUDE' FROM z WHERE fragmented),
    d AS (SELECT path, coalesce(string_agg(code || ':' || sev, ',' ORDER BY code) FILTER (WHERE code IS NOT NULL), '') AS flags, coalesce(bool_or(sev = 'EXCLUDE'), false) AS ex, coalesce(bool_or(sev = 'ATTENTION'), false) AS att FROM z LEFT JOIN fl USING (path) GROUP BY 1)
"""


@query("blink_channels", BLINK + "SELECT channel, frames, clean_frames, round(sources_best + 1e-9, 4) AS sources_best, round(fwhm_best + 1e-9, 6) AS fwhm_best, round(sky_clean + 1e-9, 4) AS sky_clean, round(gradient_clean + 1e-9, 5) AS gradient_clean FROM b JOIN c USING (channel)")
def blink_channels(spark, sf_dir):
    out = blink.channels(judged(spark, sf_dir))
    return out.select("channel", "frames", "clean_frames", r("sources_best", 4).alias("sources_best"), r("fwhm_best").alias("fwhm_best"), r("sky_clean", 4).alias("sky_clean"), r("gradient_clean", 5).alias("gradient_clean"))


@query("blink_flags", BLINK + "SELECT path, flags, CASE WHEN finite_fraction IS NULL THEN 'GATE_FINITE_FRACTION_MISSING' ELSE '' END AS notes, CASE WHEN ex THEN 'DROP' ELSE 'KEEP' END AS decision FROM d JOIN z USING (path)")
def blink_flags(spark, sf_dir):
    out = blink.flagged(judged(spark, sf_dir))
    flags = F.array_join(F.array_sort(F.transform("flags", lambda f: F.concat_ws(":", f["code"], f["severity"]))), ",")
    return out.select("path", flags.alias("flags"), F.array_join("notes", ",").alias("notes"), "decision")


@query(
    "blink_nights",
    BLINK
    + """SELECT channel, coalesce(night, 'UNKNOWN') AS night, count(*) AS frames_of_night, round(median(sky) + 1e-9, 4) AS median_sky, round(median(source_ratio) + 1e-9, 6) AS source_ratio, round(median(extinction) + 1e-9, 6) AS median_extinction,
    count(*) FILTER (WHERE ex) AS exclude, count(*) FILTER (WHERE NOT ex AND att) AS attention, bool_and(ex) AS drop_night FROM z JOIN d USING (path) GROUP BY 1, 2""",
)
def blink_nights(spark, sf_dir):
    out = blink.night_summaries(blink.flagged(judged(spark, sf_dir)))
    return out.select("channel", "night", "frames_of_night", r("median_sky", 4).alias("median_sky"), r("source_ratio").alias("source_ratio"), r("median_extinction").alias("median_extinction"), "exclude", "attention", "drop_night")
