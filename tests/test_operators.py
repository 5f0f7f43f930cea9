"""Operators against plain Python on small, odd inputs: nulls, NaN, ties, single rows, empty tables."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framestack.functions import sky, text
from framestack.operators import gate, grids, grouping, joins, network, photometry, stack, stats, tiles, windows

NAN = float("nan")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("a", v, 1.0, i) for i, v in enumerate([3.0, 1.0, NAN, 10.0, 2.5, 7.0, None, float("inf")])] + [("b", 5.0, 2.0, 9), ("c", None, 1.0, 10), ("d", 4.0, 0.0, 11), ("d", 4.0, 0.0, 12)]
    return spark.createDataFrame(rows, "g string, v double, w double, i int")


def test_clip_mean_of_odd_groups(odd):
    got = {r["g"]: r for r in stack.clip_mean(odd, ["g"], "v", "w").collect()}
    assert (got["a"]["n"], got["a"]["med"], got["a"]["mad"]) == (5, 3.0, 2.0)
    assert (got["b"]["n"], got["b"]["mean"], got["b"]["n_accepted"]) == (1, 5.0, 1)
    assert got["c"]["n"] == 0 and got["c"]["mean"] is None and got["d"]["mean"] is None
    big = {r["g"]: r for r in stack.clip_mean_large(odd, ["g"], "v", "w").collect()}
    for g, r in got.items():
        assert big[g].asDict() == r.asDict(), g
    assert stack.clip_mean(odd.where("false"), ["g"], "v").count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3), st.just(NAN), st.integers(0, 3).map(float)), min_size=1, max_size=40), q=st.sampled_from([0.0, 0.1, 0.5, 0.95, 1.0]))
def test_exact_quantile_is_numpys(spark, values, q):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    want = [v for v in values if v is not None and not math.isnan(v)]
    got = stats.exact_quantile(df, ["k"], "v", q, bins=4).collect()
    assert [pytest.approx(np.quantile(want, q), abs=1e-9)] == [r["quantile"] for r in got] if want else not got


def test_peers_leave_the_row_itself_out(odd):
    values = [3.0, 1.0, 10.0, 2.5, 7.0]
    for r in windows.without_self(odd, ["g"], "v").where("g = 'a'").collect():
        own = r["v"] if r["v"] is not None and math.isfinite(r["v"]) else None
        others = sorted(values)
        if own is not None:
            others.remove(own)
        assert (r["peer_low"], r["peer_median"], r["peer_high"]) == (others[0], np.median(others), others[-1])
    assert windows.without_self(odd, ["g"], "v").where("g in ('b', 'c') and peer_median is not null").count() == 0


def test_gap_blocks_part_only_above_the_gap(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["2024-01-01 20:00:00", "2024-01-01 22:00:00", "2024-01-02 00:00:01"])], "i int, t string").withColumn("ts", F.to_timestamp("t")).withColumn("k", F.lit(1))
    assert [r["block"] for r in windows.gap_blocks(df, ["k"], "ts", tie="i").orderBy("i").collect()] == [0, 0, 1]
    assert str(df.select(windows.night(F.col("ts")).alias("n")).first()["n"]) == "2024-01-01"


def test_greedy_match_is_the_sequential_one(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(g), int(a), int(b), float(d)) for g, a, b, d in zip(rng.integers(0, 3, 120), rng.integers(0, 12, 120), rng.integers(0, 12, 120), rng.integers(1, 30, 120) / 10)]
    pairs = sorted({(g, a, b): (g, a, b, d) for g, a, b, d in pairs}.values())
    want, used = set(), set()
    for g, a, b, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if (g, "l", a) not in used and (g, "r", b) not in used:
            used |= {(g, "l", a), (g, "r", b)}
            want.add((g, a, b))
    df = spark.createDataFrame(pairs, "g int, left_id int, right_id int, distance double")
    assert {(r["g"], r["left_id"], r["right_id"]) for r in joins.greedy_match(df, ["g"]).collect()} == want
    assert joins.greedy_match(df.where("false"), ["g"]).count() == 0


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in joins.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


def test_bridge_multiplies_matrices(spark):
    a, b = np.array([[2.0, 0, 1], [0, 2, 3], [0, 0, 1]]), np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    df = spark.createDataFrame([("x", "m", a.ravel().tolist(), 40), ("m", "r", b.ravel().tolist(), 50)], "src string, ref string, m array<double>, matches int")
    row = joins.via_bridge(df).first()
    assert (row["src"], row["ref"], row["bridge"]) == ("x", "r", "m") and np.allclose(np.array(row["m"]).reshape(3, 3), b @ a)


def test_compatibility_of_unknowns(spark):
    df = spark.createDataFrame([({"N": "1", "P": "a"}, {"N": "1"}), ({"N": "1"}, {"N": "2"}), ({}, {"N": "2"})], "l map<string,string>, r map<string,string>")
    assert [r[0] for r in df.select(joins.keywords_compatible(F.col("l"), F.col("r"))).collect()] == [True, False, True]
    one = spark.range(1).select(joins.same_or_unknown(F.lit(None).cast("int"), F.lit(1)).alias("a"), joins.same_and_known(F.lit(None).cast("int"), F.lit(1)).alias("b")).first()
    assert (one["a"], one["b"]) == (True, False)


def test_tolerance_split_follows_the_running_mean(spark):
    df = spark.createDataFrame([("k", v) for v in (10.0, 10.0, 11.0, 12.5, 30.0)] + [("k", None)], "k string, v double")
    got = sorted(((r["v"], r["split"]) for r in grouping.tolerance_split(df, ["k"], "v", 2.0).collect()), key=lambda x: (x[0] is None, x[0]))
    assert [s for _, s in got] == [0, 0, 0, 1, 2, None]


def test_network_recovers_offsets(spark):
    truth = {"a": 1.0, "b": -0.5, "c": 0.2, "d": -0.7}
    edges = [(u, v, truth[u] - truth[v], 100.0) for u in truth for v in truth if u < v]
    edges[0] = (*edges[0][:2], edges[0][2] + 50, 1e-4)
    got = network.panel_offsets(spark.createDataFrame(edges, "u string, v string, d double, w double"), "u", "v", "d", "w")
    assert all(abs(got[k] - truth[k]) < 1e-3 for k in truth)
    assert network.bic(100, 10.0, 2) < network.bic(100, 20.0, 2)


def test_the_gate_keeps_the_worst_of_a_family(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    row = spark.range(1).select(gate.worst(gate.finding("B", 2, t), gate.finding("A", 3, t), gate.finding("D", 4, n)).alias("x"), gate.worst(gate.finding("A", 2, t), gate.finding("B", 2, t)).alias("y"), gate.worst(gate.finding("D", 4, F.lit(False))).alias("z")).first()
    assert row["x"]["code"] == "GATE_A" and row["y"]["code"] == "GATE_B" and row["z"] is None


def good_frames(n=8):
    """A cohort of one clear night: all pass."""
    one = dict(cohort="c", night="2026-01-01", reference="f0", role="LIGHT", status="MEASURED", identity="i", result_identity="i", finite_fraction=1.0, dynamic_range=500.0, image_mad=20.0, texture=20.0, registration_ok=True, matched_stars=40, match_fraction=0.8, rms=0.3, overlap=1.0, dimming=0.02, completeness=0.98, source_ratio=1.0, shape_stars=40, hfr=2.0, fwhm=3.0, ellipticity=0.1, ellipticity_p90=0.2, elongated=0.0, coherence=0.1, fragmented=False)
    return [one | dict(path=f"f{i}", airmass=1 + 0.06 * i, transparency=10 ** (-0.4 * 0.55 * 0.06 * i), image_median=1000.0 + i, source_count=400.0) for i in range(n)]


@pytest.mark.parametrize(
    ("change", "code", "disposition"),
    [
        ({}, None, "PASS"),
        ({"status": None}, "GATE_MEASUREMENT_MISSING", "HARD_FAIL"),
        ({"result_identity": "j"}, "GATE_IDENTITY_MISMATCH", "HARD_FAIL"),
        ({"finite_fraction": 0.94}, "GATE_FINITE_FRACTION_HARD", "HARD_FAIL"),
        ({"finite_fraction": 0.99}, "GATE_FINITE_FRACTION_REVIEW", "REVIEW"),
        ({"dynamic_range": 0.0}, "GATE_NEAR_CONSTANT_IMAGE", "HARD_FAIL"),
        ({"matched_stars": 10}, "GATE_REGISTRATION_REVIEW", "REVIEW"),
        ({"field_coverage": 0.5}, "GATE_FIELD_OFFSET_HARD", "HARD_FAIL"),
        ({"overlap": 0.3}, "GATE_COMMON_FOOTPRINT_REVIEW", "REVIEW"),
        ({"dimming": 0.3}, "GATE_SPATIAL_DIMMING_REVIEW", "REVIEW"),
        ({"image_median": 2000.0}, "GATE_BACKGROUND_STRONG", "REVIEW"),
        ({"fwhm": 4.2}, "GATE_FOCUS_SEEING_REVIEW", "REVIEW"),
        ({"fragmented": True}, "GATE_FRAGMENTED_TRAILING_HARD", "HARD_FAIL"),
        ({"ellipticity": 0.5, "elongated": 0.7, "coherence": 0.9}, "GATE_COHERENT_TRAILING_HARD", "HARD_FAIL"),
        ({"missing_area": 0.35, "missing_density": 0.2, "background_support": 0.6}, "GATE_OCCLUSION_HARD", "HARD_FAIL"),
        ({"night": None}, "GATE_NIGHT_UNRESOLVED", "REVIEW"),
        ({"dimming": 0.5, "image_median": 2000.0}, "GATE_MULTI_FAMILY_CLOUD_HARD", "HARD_FAIL"),
    ],
)
def test_gate_of_one_changed_frame(gated, change, code, disposition):
    got = gated[repr(change)]
    assert got["disposition"] == disposition and (code is None and not got["gate_codes"] or code in got["gate_codes"]), got["gate_codes"]


@pytest.fixture(scope="module")
def gated(spark):
    """The changed frame of each case, judged in one run: a case is a cohort of its own."""
    cases = [m for mark in test_gate_of_one_changed_frame.pytestmark for m in mark.args[1]]
    rows = [dict(f, cohort=repr(change), path=f"{n}-{f['path']}", reference=f"{n}-f0", **{k: v for k, v in change.items() if i == 5}) if i != 5 else f | {"cohort": repr(change), "path": f"{n}-f5", "reference": f"{n}-f0"} | change for n, (change, _, _) in enumerate(cases) for i, f in enumerate(good_frames())]
    kinds = {"cohort": "string", "night": "string", "path": "string"} | gate.FRAME
    df = spark.createDataFrame([[r.get(k) for k in kinds] for r in rows], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return {r["cohort"]: r for r in gate.evaluate(df).collect() if r["path"].endswith("-f5")}


def test_grid_helpers(spark):
    g = F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(10.0), F.lit(11.0)))
    row = spark.range(1).select(grids.bilinear(g, 2, 2, F.lit(0.5), F.lit(0.25)).alias("a"), grids.bilinear(g, 2, 2, F.lit(9.0), F.lit(-1.0)).alias("b")).first()
    assert row["a"] == 5.25 and row["b"] == 10.0
    p = spark.createDataFrame([(0, 5.0, 5.0, 8.0, 2.0), (0, None, 1.0, 1.0, 1.0)], "k int, x double, y double, v double, w double")
    cells = grids.splat(p.withColumn("x", F.col("x") + 0.5), ["k"], "x", "y", "v", "w").collect()
    assert sorted((r["ox"], r["oy"], r["weight"]) for r in cells) == [(5, 5, 1.0), (6, 5, 1.0)] and {r["value"] for r in cells} == {8.0}


def test_stamps_and_votes(spark):
    s = spark.createDataFrame([(0, x, y, float(10 * y + x)) for x in range(8) for y in range(8)], "k int, x int, y int, value double")
    p = spark.createDataFrame([(0, 1, 3.9, 4.2)], "k int, id int, x double, y double")
    got = {(r["dx"], r["dy"]): r["value"] for r in photometry.stamps(p, s, ["k"], "id", "x", "y", 1, tile=4).collect()}
    assert len(got) == 9 and got[0, 0] == 44.0 and got[1, -1] == 35.0
    rng = np.random.default_rng(4)
    pts = [(0, i, float(x), float(y), float(9 - i)) for i, (x, y) in enumerate(rng.uniform(0, 100, (6, 2)))]
    turned = [(0, i, -2 * y + 5, 2 * x - 3, f) for _, i, x, y, f in pts]
    t = [photometry.triangles(spark.createDataFrame(q, "k int, id int, x double, y double, f double"), ["k"], "id", "x", "y", "f", 6) for q in (pts, turned)]
    votes = photometry.triangle_votes(*t, ["k"], 0.001).collect()
    best = {i: max((r for r in votes if r["left_id"] == i), key=lambda r: r["votes"])["right_id"] for i in range(6)}
    assert best == {i: i for i in range(6)}


def test_scalar_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    assert val(sky.sexagesimal(F.lit("-0:30:36"))) == pytest.approx(-0.51) and val(sky.sexagesimal(F.lit("x"))) is None
    assert val(sky.midtones(F.lit(0.25), 0.25)) == pytest.approx(0.5) and val(sky.airmass(F.lit(-3.0))) is None and val(sky.airmass(F.lit(90.0))) == pytest.approx(1, abs=1e-3)
    x, y = sky.gnomonic(F.lit(10.5), F.lit(20.0), 10.0, 20.0)
    assert val(x) == pytest.approx(0.5 * math.cos(math.radians(20)), abs=1e-4) and abs(val(y)) < 1e-2
    assert val(sky.separation(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))) == pytest.approx(90)
    assert val(text.filter_name(F.lit(" h-Alpha "))) == "HA" and val(text.filter_name(F.lit("'Astrodon 5nm'"))) == "ASTRODON 5NM" and val(text.filter_name(F.lit("Sulphur II"))) == "SII" and val(text.filter_name(F.lit(" "))) is None and val(text.frame_role(F.lit("Dark Frame"))) == "DARK"
    assert val(text.path_keywords(F.lit("a/NIGHT_1/night-2/x_PANEL 3.fits"), ["NIGHT", "PANEL"])) == {"NIGHT": "2", "PANEL": "3.fits"}
    assert val(text.path_keywords(F.lit("x.NIGHT_2024-03-22_a/Panel 3 (b): c /night_/nights_9.fits"), ["NIGHT", "panel"])) == {"NIGHT": "2024-03-22", "PANEL": "3 (b): c"}
    assert val(text.seconds_in_name(F.lit("light_1.5sec_3.fits"))) == 1.5 and val(text.csv_safe(F.lit("=1"))) == "'=1"


def test_roles_in_paths(spark):
    want = {"/a/light-frame-qc/x/DARK/0001.fits": "DARK", "/a/b/masterFlatDark_60s.xisf": "MASTER_DARK", "/n1/Flat_R_001.fits": "FLAT", "/n1/M31_300s.fits": None, "/s/Zero/1.fits": "BIAS"}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", text.role_in_path(F.col("p")).alias("r")).collect()
    assert {r["p"]: r["r"] for r in got} == want


def test_debayer_leaves_missing_samples_out():
    raw = np.arange(36, dtype=np.float32).reshape(6, 6)
    raw[2, 2] = np.nan
    out = tiles.debayer(raw)
    assert np.argwhere(~np.isfinite(out)).tolist() == [[0, 2, 2]] and out[0, 2, 3] == raw[2, 4]


def test_repeated_targets_stay_apart(spark):
    t = spark.createDataFrame([(1, 5), (1, 5), (2, 9)], "id int, v int")
    g = spark.createDataFrame([(4, "a"), (8, "b")], "w int, grp string")
    got = joins.best_match(t, "id", g, [], F.col("w") <= F.col("v"), [F.abs(F.col("v") - F.col("w"))], [F.col("grp")]).collect()
    assert sorted((r["id"], r["candidates"], r["grp"]) for r in got) == [(1, 1, "a"), (1, 1, "a"), (2, 2, "b")]
