"""Photometric networks of mosaics: gains and additive surfaces of panels from what they share.

A network's rows say that a combination of one panel's unknowns, less one of another's, is near a target.  solve() is
robust weighted least squares over any number of panels: each pass sums the rows' outer products into blocks
of panel pairs (partial sums in the map tasks, then one shuffle) and runs conjugate gradients whose products of
matrix and vector are joins and sums of tables, preconditioned by exact solutions within blocks of
neighbouring panels.  No matrix, vector or list of panels is ever on the driver; an iteration is one job, and
one number is read now and then to see whether it may stop.

On top of it: scales() fits one gain, or a gain with a gradient, and chooses by the Bayesian criterion;
sky_bins() are medians of bins at least half valid; surfaces() fits a polynomial a panel from overlaps and
sky, in rounds whose bound on what counts as sky is halved.

Panels are named by strings.  Rows with a null name, target or sigma, or a sigma that is not positive, carry no
information and are left out; a panel without rows has no solution row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import cut
from .stats import MADN, clean, exact_quantile

#: Fixed values of the model: where Huber's loss turns linear, passes of re-weighting, the prior on a gain's gradient.
HUBER, PASSES, GRADIENT_PRIOR = 1.5, 4, 0.05
#: Powers of u and v in a panel's surface, and what its shape may be in pixel noise by degree.
POWERS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))
SHAPE_NOISE = {1: 0.3, 2: 0.1, 3: 0.03}
BIN_PIXELS, SKY_PIXELS, PRIOR_BINS, LEAK = 32, 64, 600, 0.1
SKY_REJECTION, SKY_TOLERANCE, SKY_ROUNDS = 2.5, 0.5, 12
#: The panel that stands for the level which all sky bins share.
LEVEL = "\0level"
#: Iterations between looks at the residual, and the most of them.
LOOK, MOST = 3, 400
#: Neighbouring panels that precondition together.
BLOCK_PANELS = 32


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def network_rows(left: Column, right: Column, tl: Column, tr: Column, target: Column, sigma: Column, robust: bool = True) -> list[Column]:
    """Columns of a row: tl . x[left] - tr . x[right] is near target, to sigma; no right panel where it is null."""
    return [left.cast("string").alias("left"), right.cast("string").alias("right"), tl.cast("array<double>").alias("tl"), tr.cast("array<double>").alias("tr"), clean(target).alias("target"), clean(sigma).alias("sigma"), F.lit(robust).alias("robust")]


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("left is not null and target is not null and sigma > 0")


def _residuals(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with r, the normalised residual, and w2, the square of a row's weight over its sigma."""
    if found is None:
        return rows.withColumns({"r": F.col("target") / F.col("sigma"), "w2": 1 / (F.col("sigma") * F.col("sigma"))})
    got = rows.join(found.select(F.col("panel").alias("left"), F.col("x").alias("xl")), "left", "left").join(found.select(F.col("panel").alias("right"), F.col("x").alias("xr")), "right", "left")
    said = F.coalesce(_dot("tl", "xl"), F.lit(0.0)) - F.coalesce(_dot("tr", "xr"), F.lit(0.0))
    got = got.withColumn("r", (F.col("target") - said) / F.col("sigma")).drop("xl", "xr")
    huber = F.when(F.col("robust") & (F.abs("r") > HUBER), HUBER / F.abs("r")).otherwise(1.0)
    return got.withColumn("w2", huber / (F.col("sigma") * F.col("sigma")))


def _normal_blocks(rows: DataFrame, terms: int) -> DataFrame:
    """(i, j, block, right): blocks of the normal equations; right only where i = j.  Both halves of the symmetric matrix."""
    numbers = "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.array([x if x is not None else "\0none" for x in c.to_pylist()], object) for c in (batch.column(0), batch.column(1)))
            if not len(left):
                continue
            fill = lambda c: np.array([x if x is not None else [0.0] * terms for x in c.to_pylist()], float)
            design = np.hstack([fill(batch.column(2)), -fill(batch.column(3))])
            target, w2 = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            names, which = np.unique(np.array([f"{a}\1{b}" for a, b in zip(left, right)], object), return_inverse=True)
            order = np.argsort(which, kind="stable")
            out = []
            for k, part in zip(names, np.split(order, np.cumsum(np.bincount(which, minlength=len(names)))[:-1])):
                a, b = k.split("\1")
                m = design[part]
                weighted = m * w2[part][:, None]
                square, toward = m.T @ weighted, weighted.T @ target[part]
                out.append((a, a, square[:terms, :terms].ravel(), toward[:terms]))
                if b != "\0none":
                    out.append((b, b, square[terms:, terms:].ravel(), toward[terms:]))
                    out.append((a, b, square[:terms, terms:].ravel(), np.zeros(terms)))
                    out.append((b, a, square[terms:, :terms].ravel(), np.zeros(terms)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), *(pa.array([o[n].tolist() for o in out], pa.list_(pa.float64())) for n in (2, 3))], ["i", "j", "block", "right"])

    parts = rows.select("left", "right", "tl", "tr", "target", "w2").mapInArrow(run, f"i string, j string, block {numbers}, right {numbers}")
    summed = lambda c, n: F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(c)
    return parts.groupBy("i", "j").agg(summed("block", terms * terms), summed("right", terms))


def placed(panels: DataFrame, most: int = BLOCK_PANELS) -> DataFrame:
    """(panel, block, slot): panels (panel, x0, y0, x1, y1) in blocks of neighbours, at most about `most` of them together.

    Blocks only speed conjugate gradients up; where many panels share a cell, a hash of their names splits it.
    """
    centre = panels.where("panel is not null").groupBy(F.col("panel").cast("string").alias("panel")).agg(F.min(F.col("x0") + F.col("x1")).alias("x"), F.min(F.col("y0") + F.col("y1")).alias("y"))
    span = centre.agg(F.count("*").alias("n"), F.min("x").alias("lx"), F.min("y").alias("ly"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1.0)) * 1.0001).alias("w"))
    side = F.greatest(F.ceil(F.sqrt(2 * F.col("n") / most)), F.lit(1))
    cell = lambda c, lo: F.floor((F.col(c) - F.col(lo)) / F.col("w") * side)
    cells = centre.crossJoin(F.broadcast(span)).select("panel", F.when(F.col("n") <= most, F.lit("")).otherwise(F.concat_ws(":", cell("x", "lx"), cell("y", "ly"))).alias("cell"))  # one row
    full = cells.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    blocks = cells.join(full, "cell").select("panel", F.concat_ws(":", "cell", F.pmod(F.xxhash64("panel"), F.col("parts"))).alias("block"))
    return blocks.withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy("panel")) - 1)


def _assembled(blocks: DataFrame, places: DataFrame, terms: int) -> tuple[DataFrame, DataFrame]:
    """(block, factor, right) and the entries (i, a, j, b, value) of the normal equations, i and j being blocks of panels.

    factor is F with F^T F the inverse of a block's own part, without the directions that it does not measure.
    """
    at = lambda n: places.select(F.col("panel").alias(n), F.col("block").alias(f"b{n}"), F.col("slot").alias(f"s{n}"))
    placed_blocks = blocks.join(at("i"), "i").join(at("j"), "j")
    flat = placed_blocks.select("bi", "si", "bj", "sj", F.posexplode("block").alias("at", "value")).where("value <> 0")
    entries = flat.select(F.col("bi").alias("i"), (F.col("si") * terms + F.floor(F.col("at") / terms)).cast("int").alias("a"), F.col("bj").alias("j"), (F.col("sj") * terms + F.col("at") % terms).cast("int").alias("b"), "value")
    entries = cut(entries)
    # A block has at most a few times BLOCK_PANELS panels, so its entries and its right side are bounded.
    own = entries.where("i = j").groupBy("i").agg(F.collect_list(F.struct("a", "b", "value")).alias("own"))
    toward = placed_blocks.where("i = j").select(F.col("bi").alias("i"), F.posexplode("right").alias("at", "value"), "si").groupBy("i").agg(F.collect_list(F.struct((F.col("si") * terms + F.col("at")).alias("a"), "value")).alias("toward"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            factors, rights = [], []
            for mine, side in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = 1 + max(e["a"] for e in side)
                matrix, right = np.zeros((n, n)), np.zeros(n)
                np.add.at(matrix, ([e["a"] for e in mine], [e["b"] for e in mine]), [e["value"] for e in mine])
                np.add.at(right, [e["a"] for e in side], [e["value"] for e in side])
                unit = np.where(np.diag(matrix) > 0, 1 / np.sqrt(np.maximum(np.diag(matrix), 1e-300)), 0.0)
                value, vector = np.linalg.eigh((matrix + matrix.T) / 2 * unit[:, None] * unit[None, :])
                scale = np.where(value > 1e-12 * max(value.max(), 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
                factors.append((scale[:, None] * vector.T * unit[None, :]).ravel().tolist())
                rights.append(right.tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(factors, kind), pa.array(rights, kind)], ["block", "factor", "right"])

    sides = cut(own.join(toward, "i").mapInArrow(run, "block string, factor array<double>, right array<double>"))
    return sides, entries


def conjugate_gradients(sides: DataFrame, entries: DataFrame, start: DataFrame | None = None, tolerance: float = 1e-10, most: int = MOST) -> DataFrame:
    """(block, x) that solves the assembled equations, preconditioned by the blocks' own parts.

    Unknowns that the rows cannot tell apart stay where they start (zero).  The state is a row a block; an iteration
    is one job that multiplies (a join of entries with the direction, and sums), takes two global sums, and writes the
    next state.  The driver sees a residual every LOOK iterations.
    """
    vectors = ("x", "r", "p", "s", "u")
    kind = "block string, " + ", ".join(f"{v} array<double>" for v in vectors) + ", gamma double, alpha double"

    def times(state: DataFrame, v: str) -> DataFrame:
        """(block, w): the matrix times vector v, as (place, value) pairs."""
        spread = state.select(F.col("block").alias("j"), F.posexplode(v).alias("b", "v"))
        summed = entries.join(spread, ["j", "b"]).groupBy("i", "a").agg(F.sum(F.col("value") * F.col("v")).alias("w"))
        return summed.groupBy(F.col("i").alias("block")).agg(F.collect_list(F.struct("a", "w")).alias("w"))

    def dense(pairs, n):
        out = np.zeros(n)
        for e in pairs or ():
            out[e["a"]] = e["w"]
        return out

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x, r, p, s, u = (np.array(row[v]) for v in vectors)
                factor = np.array(row["factor"]).reshape(len(x), len(x))
                w = dense(row["w"], len(x))
                if row["first"]:  # r is the right side, less what the start gives
                    r = r - w
                    gamma, alpha = None, None
                else:
                    gamma, delta = row["g"], row["d"]
                    beta = gamma / row["g0"] if row["g0"] else 0.0
                    below = delta - (beta * gamma / row["a0"] if row["a0"] else 0.0)
                    alpha = gamma / below if below > 0 else 0.0
                    p, s = u + beta * p, w + beta * s
                    x, r = x + alpha * p, r - alpha * s
                u = factor.T @ (factor @ r)
                out.append((row["block"], *(v.tolist() for v in (x, r, p, s, u)), gamma, alpha))
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), [pa.string(), *[pa.list_(pa.float64())] * 5, pa.float64(), pa.float64()])]
            if out:
                yield pa.RecordBatch.from_arrays(arrays, ["block", *vectors, "gamma", "alpha"])

    def advance(state: DataFrame, first: bool) -> DataFrame:
        met = state.join(times(state, "x" if first else "u"), "block", "left")
        if first:
            met = met.withColumns({n: F.lit(None).cast("double") for n in ("g", "d", "g0", "a0")})
        else:
            along = F.aggregate("w", F.lit(0.0), lambda t, e: t + e["w"] * F.get("u", e["a"]))
            sums = met.agg(F.sum(_dot("r", "u")).alias("g"), F.sum(along).alias("d"), F.max("gamma").alias("g0"), F.max("alpha").alias("a0"))
            met = met.crossJoin(F.broadcast(sums))  # one row
        return cut(met.join(sides.select("block", "factor"), "block").withColumn("first", F.lit(first)).mapInArrow(stepped, kind))

    zero = F.transform("right", lambda _: F.lit(0.0))
    begin = sides.join(start, "block", "left") if start is not None else sides.withColumn("x", zero)
    begin = begin.select("block", F.coalesce("x", zero).alias("x"), F.col("right").alias("r"), zero.alias("p"), zero.alias("s"), zero.alias("u"), F.lit(None).cast("double").alias("gamma"), F.lit(None).cast("double").alias("alpha"))
    goal = (sides.agg(F.sum(_square("right", "factor"))).first()[0] or 0.0) * tolerance**2
    state = advance(begin, True)
    for step in range(most):
        if (step < 3 or step % LOOK == 0) and (state.agg(F.sum(_dot("r", "u"))).first()[0] or 0.0) <= goal:
            break
        state = advance(state, False)
    return state.select("block", "x")


def _square(right: str, factor: str) -> Column:
    """|F right|^2, the size of a right side as the preconditioner sees it."""
    n = F.size(right)
    line = lambda k: F.aggregate(F.zip_with(F.slice(factor, k * n + 1, n), right, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), line), F.lit(0.0), lambda t, x: t + x * x)


def solve(rows: DataFrame, terms: int, places: DataFrame | None = None, passes: int = PASSES, tolerance: float = 1e-10) -> DataFrame:
    """(panel, x array<double>) of network rows: least squares, re-weighted by Huber's loss in each pass.

    places is as placed() gives it; panels that it lacks, or all without it, are blocks of their own.  Passes before the last one
    need only the weights right, and stop at a thousand times the tolerance; a pass that finds nothing to weigh down is the last.
    """
    rows = cut(_usable(rows))
    panels = rows.select(F.col("left").alias("panel")).union(rows.where("right is not null").select("right")).distinct()
    if places is not None:
        panels = panels.join(places, "panel", "left").select("panel", F.coalesce("block", F.concat(F.lit("\0"), "panel")).alias("block"), F.coalesce("slot", F.lit(0)).alias("slot"))
    else:
        panels = panels.select("panel", F.col("panel").alias("block"), F.lit(0).alias("slot"))
    # slots without gaps: a block may hold panels that no row names
    panels = cut(panels.withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy("slot", "panel")) - 1))
    found = start = None
    last = False
    for turn in range(passes):
        weighted = _residuals(rows, found)
        if turn == passes - 1 or (turn and not weighted.where(F.col("robust") & (F.abs("r") > HUBER)).head(1)):
            last = True  # nothing to weigh anew
        sides, entries = _assembled(cut(_normal_blocks(weighted, terms)), panels, terms)
        start = conjugate_gradients(sides, entries, start, tolerance * (1 if last else 1000))
        found = cut(panels.join(start, "block").select("panel", F.slice("x", F.col("slot") * terms + 1, terms).alias("x")))
        if last:
            break
    return found


def loss(rows: DataFrame, found: DataFrame) -> tuple[int, float]:
    """(rows, Huber's loss) of the robust rows at a solution."""
    size = F.abs("r")
    of = F.when(size <= HUBER, size * size).otherwise(2 * HUBER * size - HUBER * HUBER)
    got = _residuals(_usable(rows), found).where("robust").agg(F.count("*"), F.sum(of)).first()
    return got[0], got[1] or 0.0


# -- gains ----------------------------------------------------------------------------------------


def scale_rows(observations: DataFrame, centre: tuple[float, float], length: float, gradients: bool) -> DataFrame:
    """Network rows of (left, right, x, y, log_ratio, error): scaled panels agree at every bin of their overlap."""
    u, v = (F.col("x") - centre[0]) / length, (F.col("y") - centre[1]) / length
    terms = F.array(F.lit(1.0), u, v) if gradients else F.array(F.lit(1.0))
    rows = observations.select(*network_rows(F.col("left"), F.col("right"), terms, terms, -F.col("log_ratio"), F.greatest("error", F.lit(1e-5))))
    if not gradients:
        return rows
    panels = observations.select(F.col("left").alias("panel")).union(observations.select("right")).distinct()
    priors = panels.select("panel", F.explode(F.array(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))).alias("t"))
    none = F.lit(None)
    return rows.unionByName(priors.select(*network_rows(F.col("panel"), none, F.col("t"), none, F.lit(0.0), F.lit(GRADIENT_PRIOR), robust=False)))


def scales(observations: DataFrame, panels: DataFrame) -> DataFrame:
    """(panel, model, log_scale, scale, a, b, u0, v0, length) of each panel: gain(x, y) = scale exp(a u + b v).

    observations are as for scale_rows; panels (panel, x0, y0, x1, y1, exposure) gives boxes and exposures.  A
    gradient is kept only where it lowers the Bayesian criterion of the robust loss against one scale a panel.
    The panel with the most flux a second keeps its scale; ties go to the lowest name.  All panels must be one
    connected network (joins.components tells).
    """
    observations = cut(observations)
    box = panels.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.count("*")).first()
    if not box[4]:
        box = (0.0, 0.0, 1.0, 1.0, 0)
    centre, length = ((box[0] + box[2] - 1) / 2, (box[1] + box[3] - 1) / 2), max(box[2] - box[0], box[3] - box[1]) / 2
    places = cut(placed(panels))
    best = None
    for model, terms in (("scale", 1), ("gainPlane", 3)):
        rows = scale_rows(observations, centre, length, terms == 3)
        found = solve(rows, terms, places)
        n, size = loss(rows, found)
        criterion = size + terms * (box[4] - 1) * float(np.log(max(n, 1)))
        if best is None or criterion < best[0]:
            best = criterion, model, found
    _, model, found = best
    at = lambda k: F.coalesce(F.get("x", F.lit(k)), F.lit(0.0))
    named = panels.select(F.col("panel").cast("string").alias("panel"), F.coalesce(F.nullif("exposure", F.lit(0.0)), F.lit(1.0)).alias("exposure"))
    known = named.join(found, "panel", "left").select("panel", "exposure", at(0).alias("level"), at(1).alias("a"), at(2).alias("b"))
    first = known.agg(F.min_by("level", F.struct(F.round(F.col("level") + F.log("exposure"), 9), "panel")).alias("zero"))
    out = known.crossJoin(F.broadcast(first))  # one row
    log_scale = F.col("level") - F.col("zero")
    return out.select("panel", F.lit(model).alias("model"), log_scale.alias("log_scale"), F.exp(log_scale).alias("scale"), "a", "b", F.lit(float(centre[0])).alias("u0"), F.lit(float(centre[1])).alias("v0"), F.lit(float(length)).alias("length"))


def gain(x: Column, y: Column) -> Column:
    """The gain at (x, y) of a row joined with scales()."""
    return F.col("scale") * F.exp(F.col("a") * (x - F.col("u0")) / F.col("length") + F.col("b") * (y - F.col("v0")) / F.col("length"))


# -- sky and surfaces -----------------------------------------------------------------------------


def sky_bins(pixels: DataFrame, panels: DataFrame) -> DataFrame:
    """(panel, col, row, x, y, value, noise): medians of bins of SKY_PIXELS each way, from every second pixel, at least half valid.

    pixels (panel, x, y, value) in canvas places; noise is MADN times the median over a panel's bins of their median deviation.
    """
    box = panels.select("panel", "x0", "y0", "x1", "y1")
    place = pixels.join(box, "panel").withColumns({"dx": F.col("x") - F.col("x0"), "dy": F.col("y") - F.col("y0")})
    whole = lambda c, lo, hi: F.floor(F.col(c) / SKY_PIXELS) < F.floor((F.col(hi) - F.col(lo)) / SKY_PIXELS)
    every = place.where((F.col("dx") % 2 == 0) & (F.col("dy") % 2 == 0) & (F.col("dx") >= 0) & (F.col("dy") >= 0) & whole("dx", "x0", "x1") & whole("dy", "y0", "y1"))
    v = clean("value")
    cells = every.where(v.isNotNull()).select("panel", F.floor(F.col("dx") / SKY_PIXELS).alias("col"), F.floor(F.col("dy") / SKY_PIXELS).alias("row"), v.alias("v"), "x0", "y0")
    half = 0.5 * (SKY_PIXELS // 2) ** 2
    keys = ["panel", "col", "row"]
    middle = cells.groupBy(*keys, "x0", "y0").agg(F.percentile("v", F.lit(0.5)).alias("value"), F.count("*").alias("n"), F.collect_list("v").alias("vs")).where(F.col("n") >= half)
    # a bin has at most (SKY_PIXELS / 2)^2 pixels, so its list is bounded
    sorted_off = F.array_sort(F.transform("vs", lambda x: F.abs(x - F.col("value"))))
    mad = (F.element_at(sorted_off, F.floor((F.col("n") + 1) / 2).cast("int")) + F.element_at(sorted_off, F.floor(F.col("n") / 2 + 1).cast("int"))) / 2
    bins = middle.select(*keys, (F.col("x0") + (F.col("col") + 0.5) * SKY_PIXELS).alias("x"), (F.col("y0") + (F.col("row") + 0.5) * SKY_PIXELS).alias("y"), "value", mad.alias("mad"))
    noise = bins.groupBy("panel").agg((MADN * F.percentile("mad", F.lit(0.5))).alias("noise"))
    return bins.join(noise, "panel").drop("mad")


def _terms(u: Column, v: Column) -> list[Column]:
    power = lambda c, n: reduce(lambda a, b: a * b, [c] * n, F.lit(1.0))
    return [power(u, p) * power(v, q) for p, q in POWERS]


def surface(x: Column, y: Column, cx: Column, cy: Column, length: Column | float, coefficients: str = "coefficients") -> Column:
    """The value at (x, y) of a panel's polynomial about its centre."""
    return reduce(lambda a, b: a + b, [F.col(coefficients)[k] * t for k, t in enumerate(_terms((x - cx) / length, (y - cy) / length))])


def _grown(kept: DataFrame, bins: DataFrame) -> DataFrame:
    """The kept bins that touch no rejected bin of their panel's grid."""
    keys = ["panel", "col", "row"]
    out = bins.select(*keys).join(kept.select(*keys), keys, "left_anti")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = out.withColumn("s", F.explode(steps)).select("panel", (F.col("col") + F.col("s.i")).alias("col"), (F.col("row") + F.col("s.j")).alias("row")).distinct()
    return kept.join(near, keys, "left_anti")


def surfaces(overlaps: DataFrame, sky: DataFrame | None, scaled: DataFrame, panels: DataFrame, rounds: int = SKY_ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """(panel, cx, cy, length, coefficients) of each panel, to be taken from the scaled panel; and the bins kept as sky.

    overlaps (left, right, x, y, left_value, right_value, noise, ratio_error) are binned medians of both panels;
    noise is that of one panel's bin, ratio_error of the pair's log ratio (its own measurement's error bounds that of the network).  Bins where the
    scale's error times the structure could reach LEAK of the noise are left out.  sky is as sky_bins() gives it
    (null: overlaps alone), scaled as scales() does.  The mean of the constant terms, weighted by area, is zero.
    """
    terms = len(POWERS)
    where = panels.select(F.col("panel").cast("string").alias("panel"), ((F.col("x0") + F.col("x1") - 1) / 2).alias("cx"), ((F.col("y0") + F.col("y1") - 1) / 2).alias("cy"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    extent = panels.agg(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).first()
    length = max(extent[0] or 1, extent[1] or 1) / 2
    known = cut(where.join(scaled.drop("model", "log_scale").withColumnRenamed("length", "unit"), "panel"))
    gained = lambda p: F.col(f"{p}.scale") * F.exp((F.col(f"{p}.a") * (F.col("x") - F.col(f"{p}.u0")) + F.col(f"{p}.b") * (F.col("y") - F.col(f"{p}.v0"))) / F.col(f"{p}.unit"))
    met = overlaps.join(known.alias("l"), F.col("left") == F.col("l.panel")).join(known.alias("r"), F.col("right") == F.col("r.panel"))
    met = met.select("left", "right", "x", "y", "ratio_error", (gained("l") * F.col("left_value")).alias("vl"), (gained("r") * F.col("right_value")).alias("vr"), F.sqrt(F.pow(gained("l") * F.col("noise"), 2) + F.pow(gained("r") * F.col("noise"), 2)).alias("noise"), F.array(*_terms((F.col("x") - F.col("l.cx")) / length, (F.col("y") - F.col("l.cy")) / length)).alias("tl"), F.array(*_terms((F.col("x") - F.col("r.cx")) / length, (F.col("y") - F.col("r.cy")) / length)).alias("tr"))
    met = met.withColumn("level", (F.col("vl") + F.col("vr")) / 2)
    middle = met.groupBy("left", "right").agg(F.percentile("level", F.lit(0.5)).alias("middle"))
    met = cut(met.join(middle, ["left", "right"]).withColumn("background", F.abs(F.col("level") - F.col("middle")) * F.col("ratio_error") <= LEAK * F.col("noise")))
    # The shape of a panel: within so many pixel noises, tighter where many bins measure it.
    sides = met.select(F.col("left").alias("panel"), "noise").union(met.select("right", "noise"))
    noises = sides.groupBy("panel").agg((F.percentile("noise", F.lit(0.5)) * BIN_PIXELS / 1.2533 / float(np.sqrt(2))).alias("pixel"), F.count("*").alias("bins"))
    tight = F.least(F.lit(1.0), F.greatest(F.lit(1 / 3), F.sqrt(PRIOR_BINS / F.col("bins"))))
    hu, hv = F.col("width") / 2 / length, F.col("height") / 2 / length
    wide = F.array(*[F.col("pixel") * tight * SHAPE_NOISE[p + q] / (F.pow(hu, p) * F.pow(hv, q)) for p, q in POWERS[1:]])
    unit = F.transform(F.sequence(F.lit(0), F.lit(terms - 1)), lambda k: F.when(k == F.col("at") + 1, 1.0).otherwise(0.0))
    none = F.lit(None)
    priors = known.join(noises, "panel").where("pixel > 0").select("panel", F.posexplode(wide).alias("at", "sigma")).select(*network_rows(F.col("panel"), none, unit, none, F.lit(0.0), F.col("sigma"), robust=False))
    base = met.where("background").select(*network_rows(F.col("left"), F.col("right"), F.col("tl"), F.col("tr"), F.col("vl") - F.col("vr"), F.col("noise"))).unionByName(priors)
    base = cut(base)
    places = cut(placed(panels))
    found, kept = solve(base, terms, places), None
    if sky is not None and sky.head(1):
        ours = sky.join(known, "panel").withColumn("g", gain_of_known())
        bins = cut(ours.select("panel", "col", "row", (F.col("g") * F.col("value")).alias("value"), (SKY_TOLERANCE * F.col("g") * F.col("noise")).alias("floor"), F.array(*_terms((F.col("x") - F.col("cx")) / length, (F.col("y") - F.col("cy")) / length)).alias("t"), "x", "y"))
        one = F.array(F.lit(-1.0), *[F.lit(0.0)] * (terms - 1))

        def excess(solution: DataFrame) -> DataFrame:
            level = solution.where(F.col("panel") == LEVEL).agg(F.coalesce(F.max(F.col("x")[0]), F.lit(0.0)).alias("level"))
            got = bins.join(solution.withColumnRenamed("x", "c"), "panel", "left").crossJoin(F.broadcast(level))  # one row
            return got.withColumn("excess", F.col("value") - F.coalesce(_dot("t", "c"), F.lit(0.0)) - F.col("level")).drop("c", "level")

        now = cut(excess(found))
        cuts = now.groupBy("panel").agg(F.percentile("excess", F.lit([0.05, 0.25])).alias("q"))
        bounds = cut(cuts.select("panel", F.col("q")[1].alias("centre"), (SKY_REJECTION * F.greatest((F.col("q")[1] - F.col("q")[0]) / 0.97, F.lit(1e-9))).alias("bound")))
        last = None
        for round_ in range(rounds):
            limit = F.greatest(F.col("bound") / 2**round_, F.col("floor"))
            over = F.col("excess") - F.col("centre")
            inside = now.join(bounds, "panel").where((over <= limit) & (over >= -2 * limit))
            candidate = cut(_grown(inside, bins).select(*bins.columns, "excess"))
            mark = candidate.agg(F.count("*"), F.sum(F.xxhash64("panel", "col", "row") % (1 << 40))).first()
            wide_still = inside.where(F.col("bound") / 2**round_ > F.col("floor")).head(1)
            if not mark[0] or (mark == last and not wide_still):
                break
            kept, last = candidate, mark
            rows = candidate.select(*network_rows(F.col("panel"), F.lit(LEVEL), F.col("t"), one, F.col("value"), F.col("floor"), robust=False))
            found = solve(base.unionByName(rows), terms, places)
            now = cut(excess(found))
            again = now.join(candidate.select("panel", "col", "row"), ["panel", "col", "row"], "left_semi")
            centre = exact_quantile(again.withColumn("k", F.lit(1)), ["k"], "excess").first()
            bounds = bounds.withColumn("centre", F.lit(float(centre["quantile"]) if centre else 0.0))
    shaped = known.select("panel", "cx", "cy", "width", "height").join(found, "panel")
    area = F.col("width") * F.col("height")
    mean = shaped.agg((F.sum(area * F.col("x")[0]) / F.sum(area)).alias("mean"))
    level = F.transform("x", lambda c, k: F.when(k == 0, c - F.col("mean")).otherwise(c))
    out = shaped.crossJoin(F.broadcast(mean)).select("panel", "cx", "cy", F.lit(float(length)).alias("length"), level.alias("coefficients"))  # one row
    return out, kept.select("panel", "col", "row", "x", "y") if kept is not None else None


def gain_of_known() -> Column:
    return F.col("scale") * F.exp((F.col("a") * (F.col("x") - F.col("u0")) + F.col("b") * (F.col("y") - F.col("v0"))) / F.col("unit"))
