"""Stacks with frames taken out equal stacks built without them; line rejection and head clusters against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestack.operators import grouping, retract, stack


def samples(spark, rng, cells=60, frames=24, wild=0.04):
    rows = []
    for c in range(cells):
        for f in range(frames):
            if rng.random() < 0.1:
                continue
            v = float(rng.normal(10, 1)) if c % 7 else 10.0
            if rng.random() < wild:
                v += float(rng.choice([-40, 60]))
            rows.append((None if c == 3 else c, f, None if rng.random() < 0.02 else v, float(rng.uniform(0.5, 2)), "x"))
    rows += [(500, 0, 1.0, 1.0, "x"), (501, 0, 1.0, 1.0, "x"), (501, 1, 9.0, 1.0, "x"), (502, 0, float("nan"), 1.0, "x")]
    return spark.createDataFrame(rows, "cell long, shot long, v double, w double, block string").withColumnRenamed("v", "value").withColumnRenamed("w", "weight")


def told(df):
    return {r["cell"]: (r["n"], round(r["mean"], 9), r["n_accepted"], r["n_rejected"]) for r in df.collect()}


def test_three_removals_equal_stacking_from_scratch(spark):
    df = samples(spark, np.random.default_rng(3))
    made = retract.build(df, ["cell"], "shot", "value", "weight")
    gone = []
    for out in ([5], [6, 7, 99], [0, 1, 2, 3, 8, 9, 10, 11, 5]):
        made = retract.remove(made, spark.createDataFrame([(x,) for x in out], "frame long"))
        gone += out
        fresh = stack.clip_mean(df.where(~F.col("shot").isin(gone)).where("value is not null and not isnan(value)"), ["cell"], "value", "weight")
        assert told(made.result()) == told(fresh)
    assert 500 not in told(made.result())


def test_certified_cells_never_change_by_removal(spark):
    """Whatever is taken from a cell within its budget, nothing else is clipped."""
    rng = np.random.default_rng(4)
    df = samples(spark, rng, 40, 40, 0.005)
    made = retract.build(df, ["cell"], "shot", "value", "weight")
    budget = {r["cell"]: r["budget"] for r in made.cells.collect()}
    by = {}
    for r in made.samples.collect():
        by.setdefault(r["cell"], []).append(r["v"])
    sure = 0
    for cell, values in by.items():
        x = np.array(values)
        for _ in range(60):
            k = int(rng.integers(0, budget[cell] + 1))
            left = np.delete(x, rng.choice(len(x), k, replace=False)) if rng.random() < 0.5 else np.sort(x)[k:] if rng.random() < 0.5 else np.sort(x)[: len(x) - k]
            if len(left) < 3 or not budget[cell]:
                continue
            med = np.median(left)
            sigma = max(1.4826 * np.median(np.abs(left - med)), 1e-7, 16 * 2.0**-23 * max(1, abs(med)))
            assert (np.abs(left - med) <= 4 * sigma).all()
            sure += 1
    assert sure > 300 and sum(b > 0 for b in budget.values()) > 10  # 24 cells are without a wild sample


def test_removal_reads_and_stacks_only_what_it_must(spark):
    """Cells without the frame keep their rows; a frame that is not there changes nothing."""
    df = samples(spark, np.random.default_rng(5), 30, 12)
    made = retract.build(df, ["cell"], "shot", "value", "weight")
    same = retract.remove(made, spark.createDataFrame([(77,)], "frame long"))
    assert told(same.result()) == told(made.result()) and same.removed.count() == 0
    none = retract.build(df.limit(0), ["cell"], "shot", "value")
    assert retract.remove(none, spark.createDataFrame([(1,)], "frame long")).result().count() == 0


def test_loop_removes_the_bad_frame_and_minds_limits(spark):
    rng = np.random.default_rng(6)
    rows = [(c, f, float(rng.normal(0, 25 if f == 4 else 8 if f == 9 else 1)), 1.0) for c in range(80) for f in range(20)]
    df = spark.createDataFrame(rows, "cell long, shot long, value double, weight double")
    panels = spark.createDataFrame([(f, "a", f == 9) for f in range(20)], "frame long, panel string, is_reference boolean")
    made, log = retract.integrate(retract.build(df, ["cell"], "shot", "value", "weight"), panels, margin=0.05)
    said = {(r["pass"], r["frame"]): (r["removed"], r["because"]) for r in log.collect()}
    assert said[1, 4] == (True, None) and said[1, 9] == (False, "REFERENCE")
    assert [r["frame"] for r in made.removed.collect()] == [4]
    assert told(made.result()) == told(stack.clip_mean(df.where("shot <> 4"), ["cell"], "value", "weight"))


def test_limits_by_hand(spark):
    frames = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "a", False), (4, "b", False), (5, "b", False), (6, "c", True), (7, "c", False), (8, None, False)], "frame long, panel string, is_reference boolean")
    bad = spark.createDataFrame([(i,) for i in (1, 2, 3, 6, 7)], "frame long")
    got = {r["frame"]: r["because"] for r in retract.removable(bad, frames, 8, 0, 1.0).collect()}
    assert got == {1: "PANEL_MINIMUM", 2: "PANEL_MINIMUM", 3: None, 6: "REFERENCE", 7: "PANEL_MINIMUM"}
    few = {r["frame"]: r["because"] for r in retract.removable(bad.where("frame <> 1"), frames, 30, 2, 0.1, least=0).collect()}
    assert few == {2: None, 3: "FRACTION_GUARD", 6: "REFERENCE", 7: "FRACTION_GUARD"}
    assert {r["because"] for r in retract.removable(bad, frames, 8, 8, 0.1, least=0, whole_block=True).collect()} == {None, "REFERENCE"}


def line_by_hand(x, w, low=5.0, high=3.5):
    pairs = sorted((v, u) for v, u in zip(x, w) if v is not None and np.isfinite(v) and u > 0)
    n = len(pairs)
    for _ in range(8):
        if len(pairs) < 5:
            break
        v = [p[0] for p in pairs]
        lo, up = 0.0, max(1e-12, 4.0 * (v[-1] - v[0]) / (len(v) - 1))
        for _ in range(10):
            b = 0.5 * (lo + up)
            a = float(np.median([y - b * i for i, y in enumerate(v)]))
            score = sum(i if y > a + b * i else -i if y < a + b * i else 0 for i, y in enumerate(v))
            lo, up = (b, up) if score > 0 else (lo, b)
        b = 0.5 * (lo + up)
        a = float(np.median([y - b * i for i, y in enumerate(v)]))
        scale = 2 * sum(abs(y - (a + b * i)) for i, y in enumerate(v)) / len(v) * (1 + b * b) ** 0.5
        if not scale > 0 or 1 + scale == 1:
            break
        kept = [p for i, p in enumerate(pairs) if -low <= (p[0] - (a + b * i)) / scale <= high]
        if len(kept) == len(pairs):
            break
        pairs = kept
    return n, round(sum(v * u for v, u in pairs) / sum(u for _, u in pairs), 9), len(pairs), n - len(pairs)


def test_linear_fit_is_the_loop(spark):
    rng = np.random.default_rng(8)
    groups = {1: [1.0] * 9, 2: [1.0, 2.0], 3: [5.0], 4: list(range(30)) + [900.0, -400.0], 5: [1.0] * 20 + [50.0], 6: [None, float("nan"), float("inf"), 3.0, 3.0]}
    groups |= {10 + k: (rng.normal(0, 1, rng.integers(3, 60)).tolist() + [float(x) for x in rng.choice([30, -60, 400], rng.integers(0, 4))]) for k in range(40)}
    rows = [(g, None if v is None else float(v), float(rng.integers(0, 4))) for g, vs in groups.items() for v in vs]
    got = {r["g"]: (r["n"], round(r["mean"], 9), r["n_accepted"], r["n_rejected"]) for r in stack.linear_fit(spark.createDataFrame(rows, "g long, v double, w double"), ["g"], "v", "w").collect()}
    want = {g: line_by_hand(*zip(*[(v, w) for h, v, w in rows if h == g])) for g in groups if any(v is not None and np.isfinite(v) and w > 0 for h, v, w in rows if h == g)}
    assert got == want and sum(w[3] > 0 for w in want.values()) > 5


@pytest.mark.parametrize("seed", [1, 2])
def test_heads_are_those_of_the_walk(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(None if g == 2 else g, f"f{rng.integers(0, 40)}", int(rng.integers(0, 3)), int(rng.integers(0, 6))) for g in range(3) for _ in range(30)]
    rows = list({(g, f): (g, f, s, x) for g, f, s, x in rows}.values())
    df = spark.createDataFrame(rows, "g long, f string, stars long, x long")
    ok = lambda a, b: abs(a - b) <= 1 and (a + b) % 4 != 3
    own = df.select(F.coalesce("g", F.lit(-1)).alias("k"), F.col("f").alias("ff"), F.col("x").alias("v"))

    def accepts(pairs):
        a, b = own.withColumnsRenamed({"ff": "f", "v": "va"}), own.withColumnsRenamed({"ff": "head", "v": "vb"})
        got = pairs.withColumn("k", F.coalesce("g", F.lit(-1))).join(a, ["k", "f"]).join(b, ["k", "head"])
        return got.where((F.abs(F.col("va") - F.col("vb")) <= 1) & ((F.col("va") + F.col("vb")) % 4 != 3))

    got = {(r["g"], r["f"]): (r["head"], r["field"]) for r in grouping.split_by_heads(df, ["g"], "f", [-F.col("stars")], accepts).collect()}
    want = {}
    for group in {r[0] for r in rows}:
        clusters = []
        for _, f, s, x in sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1])):
            at = next((i for i, c in enumerate(clusters) if ok(x, c[1])), None)
            if at is None:
                clusters.append((f, x))
                at = len(clusters) - 1
            want[group, f] = clusters[at][0], at + 1
    assert got == want
    assert grouping.split_by_heads(df.limit(0), ["g"], "f", [-F.col("stars")], accepts).count() == 0
