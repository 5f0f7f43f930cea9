"""Grids: block means, tile offsets, spatial consensus, holdout of smooth surfaces, resampling by weights."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import MADN, clean, over, with_median_mad


def block_mean(df: DataFrame, keys: list[str], y: str, x: str, value: str, block: int) -> DataFrame:
    """(keys, by, bx, n, mean) of blocks of cells; missing cells don't count."""
    v = clean(value)
    return df.groupBy(*keys, F.floor(F.col(y) / block).alias("by"), F.floor(F.col(x) / block).alias("bx")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"))


def cell_medians(df: DataFrame, keys: list[str], y: str, x: str, value: str, extent: Column, cells: int = 16) -> DataFrame:
    """(keys, row, col, n, median, madn) on a coarse grid over 0 <= y, x < extent."""
    cell = lambda c: F.least(F.floor(F.col(c) * cells / extent), F.lit(cells - 1))
    rows = df.withColumns({"row": cell(y), "col": cell(x)})
    rows = with_median_mad(rows, [*keys, "row", "col"], value)
    return rows.groupBy(*keys, "row", "col").agg(F.max("n").alias("n"), F.max("med").alias("median"), (MADN * F.max("mad")).alias("madn"))


def tile_background(df: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.70) -> DataFrame:
    """(keys, n, background): median of the samples between two quantiles of the tile."""
    v, w = clean(value), over(keys)
    rows = df.withColumns({"_lo": F.percentile(v, F.lit(low)).over(w), "_hi": F.percentile(v, F.lit(high)).over(w), "_v": v})
    return rows.where("_v between _lo and _hi").groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_v", F.lit(0.5)).alias("background"))


def tile_offset(pairs: DataFrame, keys: list[str], target: str, reference: str, scale: float = 1.0, clip: float = 3.5, least: int = 8) -> DataFrame:
    """(keys, n, offset, madn) from samples on both sides.

    Kept are pairs inside both sides' joint 5 to 70 percent quantiles; residuals beyond clip MADN are
    dropped where at least `least` remain; the offset is the median of target - scale x reference.
    """
    t, r, w = clean(target), clean(reference), over(keys)
    q = lambda c, at: F.percentile(c, F.lit(at)).over(w)
    rows = pairs.where(t.isNotNull() & r.isNotNull()).withColumns({"_t": t, "_r": r})
    rows = rows.withColumns({"_t0": q(F.col("_t"), 0.05), "_t1": q(F.col("_t"), 0.70), "_r0": q(F.col("_r"), 0.05), "_r1": q(F.col("_r"), 0.70)})
    rows = rows.where("_t between _t0 and _t1 and _r between _r0 and _r1").withColumn("_d", F.col("_t") - scale * F.col("_r"))
    rows = with_median_mad(rows, keys, "_d").withColumn("_ok", F.abs(F.col("_d") - F.col("med")) <= clip * MADN * F.col("mad"))
    rows = rows.withColumn("_use", F.when(F.count_if("_ok").over(w) >= least, F.col("_ok")).otherwise(True)).where("_use").drop("n", "med", "mad")
    rows = with_median_mad(rows, keys, "_d")
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), F.max("med").alias("offset"), (MADN * F.max("mad")).alias("madn"))


def consensus(df: DataFrame, frame: str, row: str, col: str, value: str, least_frames: int = 3, least_cells: int = 16) -> DataFrame:
    """(frame, cells, dimming, brightening) against the low envelope of each cell.

    A cell's envelope is the 10th percentile over its frames; a frame's deltas are centred on their
    median; dimming is their p90, brightening that of their negatives, neither below zero.
    """
    v = clean(value)
    rows = df.where(v.isNotNull()).withColumn("_v", v)
    cell = over([row, col])
    rows = rows.withColumns({"_f": F.count("*").over(cell), "_e": F.percentile("_v", F.lit(0.1)).over(cell)}).where(F.col("_f") >= least_frames)
    rows = rows.withColumn("_d", F.col("_v") - F.col("_e"))
    rows = rows.withColumn("_d", F.col("_d") - F.percentile("_d", F.lit(0.5)).over(over([frame])))
    up, down = F.percentile("_d", F.lit(0.9)), F.percentile(-F.col("_d"), F.lit(0.9))
    enough = F.count("*") >= least_cells
    return rows.groupBy(frame).agg(F.count("*").alias("cells"), F.when(enough, F.greatest(F.lit(0.0), up)).alias("dimming"), F.when(enough, F.greatest(F.lit(0.0), down)).alias("brightening"))


def common_coverage(df: DataFrame, frame: str, cell: list[str]) -> DataFrame:
    """(cell, frames) of the cells that at least half of all frames (rounded up) cover."""
    frames = df.agg(F.count_distinct(frame).alias("all"))
    counts = df.groupBy(*cell).agg(F.count_distinct(frame).alias("frames"))
    return counts.crossJoin(F.broadcast(frames)).where(F.col("frames") >= F.ceil(F.col("all") / 2)).drop("all")


def checkerboard_holdout(df: DataFrame, keys: list[str], row: str, col: str, value: str) -> DataFrame:
    """(keys, n, rms_raw, rms_plane): how well a plane fitted on the even cells predicts the odd ones.

    The plane comes from sums (normal equations solved in closed form), so nothing is gathered.
    """
    v = clean(value)
    rows = df.where(v.isNotNull()).withColumns({"_v": v, "_x": F.col(col).cast("double"), "_y": F.col(row).cast("double"), "_even": (F.col(row) + F.col(col)) % 2 == 0})
    e = lambda c: F.sum(F.when(F.col("_even"), c))
    x, y, z = F.col("_x"), F.col("_y"), F.col("_v")
    s = rows.groupBy(*keys).agg(
        e(F.lit(1.0)).alias("s1"), e(x).alias("sx"), e(y).alias("sy"), e(z).alias("sz"), e(x * x).alias("sxx"), e(y * y).alias("syy"), e(x * y).alias("sxy"), e(x * z).alias("sxz"), e(y * z).alias("syz")
    )
    c = {n: F.col(n) for n in ("s1", "sx", "sy", "sz", "sxx", "syy", "sxy", "sxz", "syz")}
    cxx, cyy = c["sxx"] - c["sx"] * c["sx"] / c["s1"], c["syy"] - c["sy"] * c["sy"] / c["s1"]
    cxy, cxz = c["sxy"] - c["sx"] * c["sy"] / c["s1"], c["sxz"] - c["sx"] * c["sz"] / c["s1"]
    cyz = c["syz"] - c["sy"] * c["sz"] / c["s1"]
    det = cxx * cyy - cxy * cxy
    s = s.withColumns({"bx": F.when(det > 1e-9, (cxz * cyy - cyz * cxy) / det).otherwise(0.0), "by": F.when(det > 1e-9, (cyz * cxx - cxz * cxy) / det).otherwise(0.0)})
    s = s.withColumn("b0", (c["sz"] - F.col("bx") * c["sx"] - F.col("by") * c["sy"]) / c["s1"]).withColumn("m0", c["sz"] / c["s1"])
    met = rows.where(~F.col("_even")).join(s.select(*keys, "b0", "bx", "by", "m0"), keys)
    plane = z - (F.col("b0") + F.col("bx") * x + F.col("by") * y)
    return met.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(z - F.col("m0"), 2))).alias("rms_raw"), F.sqrt(F.avg(plane * plane)).alias("rms_plane"))


def blend(samples: DataFrame, keys: list[str], value: str, weight: str, variance: str) -> DataFrame:
    """(keys, panels, value, noise): weighted mean of overlapping panels and the noise it carries."""
    w, v, s = F.col(weight).cast("double"), clean(value), clean(variance)
    use = v.isNotNull() & (w > 0)
    total = F.sum(F.when(use, w))
    return samples.groupBy(*keys).agg(F.count_if(use).alias("panels"), (F.sum(F.when(use, w * v)) / total).alias("value"), (F.sqrt(F.sum(F.when(use, w * w * s))) / total).alias("noise"))


def taper(distance: Column, width: Column | float) -> Column:
    """Rises from 0 to 1 over the width, flat at both ends."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), distance / width))
    return t * t * (3 - 2 * t)


def splat(points: DataFrame, keys: list[str], x: str, y: str, value: str, weight: str, drop: float = 1.0) -> DataFrame:
    """(keys, oy, ox, value, weight, coverage): square drops shared among output cells by overlap, then summed.

    Each drop reaches at most (drop + 1) squared cells; sums combine before the shuffle.
    """
    half = drop / 2
    px, py = clean(x), clean(y)
    rows = points.where(px.isNotNull() & py.isNotNull() & clean(value).isNotNull() & (F.col(weight) > 0))
    cells = lambda c: F.sequence(F.floor(c - half + 0.5).cast("int"), F.ceil(c + half + 0.5).cast("int") - 1)
    rows = rows.withColumn("ox", F.explode(cells(px))).withColumn("oy", F.explode(cells(py)))
    share = lambda c, o: F.greatest(F.lit(0.0), F.least(c + half, F.col(o) + 0.5) - F.greatest(c - half, F.col(o) - 0.5)) / drop
    rows = rows.withColumn("_a", share(px, "ox") * share(py, "oy")).where("_a > 0").withColumn("_w", F.col("_a") * F.col(weight))
    return rows.groupBy(*keys, "oy", "ox").agg((F.sum(F.col("_w") * clean(value)) / F.sum("_w")).alias("value"), F.sum("_w").alias("weight"), F.sum("_a").alias("coverage"))


def bilinear(grid: Column, rows: int, cols: int, y: Column, x: Column) -> Column:
    """A node grid (array of arrays) at fractional node coordinates, clamped to its edges."""
    y, x = F.greatest(F.lit(0.0), F.least(y, F.lit(float(rows - 1)))), F.greatest(F.lit(0.0), F.least(x, F.lit(float(cols - 1))))
    y0, x0 = F.least(F.floor(y), F.lit(max(0, rows - 2))).cast("int"), F.least(F.floor(x), F.lit(max(0, cols - 2))).cast("int")
    fy, fx = y - y0, x - x0
    at = lambda j, i: F.get(F.get(grid, F.least(y0 + j, F.lit(rows - 1))), F.least(x0 + i, F.lit(cols - 1)))
    return (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))


def valid_run(df: DataFrame, keys: list[str], position: str, valid: Column) -> DataFrame:
    """(keys, first, last): the longest unbroken run of valid positions, the earliest of equal ones."""
    w = Window.partitionBy(*keys).orderBy(position)
    rows = df.where(valid).withColumn("_run", F.col(position) - F.row_number().over(w))
    runs = rows.groupBy(*keys, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"))
    best = runs.groupBy(*keys).agg(F.min_by(F.struct("first", "last"), F.struct(F.col("first") - F.col("last"), "first")).alias("b"))
    return best.select(*keys, "b.first", "b.last")


def common_crop(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The intersection of boxes (x0, y0, x1, y1), null where it is empty."""
    out = boxes.groupBy(*keys).agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    whole = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return out.select(*keys, *[F.when(whole, F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def inside_corridor(pixels: DataFrame, trails: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The pixels of a frame that lie in one of its trails: |n.p - d| <= w and start <= along <= stop (range join behind an equi-join)."""
    nx, ny = F.cos("angle"), F.sin("angle")
    met = pixels.join(trails, keys)
    across, along = nx * F.col(x) + ny * F.col(y) - F.col("distance"), ny * F.col(x) * -1 + nx * F.col(y)
    return met.where((F.abs(across) <= F.col("half_width")) & (along >= F.col("start")) & (along <= F.col("stop"))).select(*pixels.columns).distinct()


def splat_soft(points: DataFrame, keys: list[str], x: str, y: str, value: str, weight: str, drop: float = 1.0, kernel: str = "gaussian") -> DataFrame:
    """splat() with other drops: `point` falls whole into its cell, `gaussian` (its FWHM the drop's width) shares the drop's area over cells within three sigmas."""
    px, py = clean(x), clean(y)
    rows = points.where(px.isNotNull() & py.isNotNull() & clean(value).isNotNull() & (F.col(weight) > 0)).withColumns({"_x": px, "_y": py, "_v": clean(value)})
    if kernel == "point":
        rows = rows.withColumns({"ox": F.floor(F.col("_x") + 0.5).cast("int"), "oy": F.floor(F.col("_y") + 0.5).cast("int"), "_a": F.lit(1.0)})
    elif kernel == "gaussian":
        sigma = drop / 2.3548200450309493
        reach = 3 * sigma
        cells = lambda c: F.sequence(F.ceil(F.col(c) - reach).cast("int"), F.greatest(F.ceil(F.col(c) - reach), F.floor(F.col(c) + reach)).cast("int"))
        bell = lambda c, o: F.exp(-F.pow(F.col(o) - F.col(c), 2) / (2 * sigma**2))
        # The shares of a point's cells are the products of the shares along each axis.
        total = lambda c: F.aggregate(cells(c), F.lit(0.0), lambda s, o: s + F.exp(-F.pow(o - F.col(c), 2) / (2 * sigma**2)))
        rows = rows.withColumns({"_tx": total("_x"), "_ty": total("_y")}).withColumn("ox", F.explode(cells("_x"))).withColumn("oy", F.explode(cells("_y")))
        rows = rows.withColumn("_a", drop * drop * bell("_x", "ox") * bell("_y", "oy") / (F.col("_tx") * F.col("_ty")))
    else:
        raise ValueError(f"kernel {kernel}")
    rows = rows.withColumn("_w", F.col("_a") * F.col(weight))
    return rows.groupBy(*keys, "oy", "ox").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("value"), F.sum("_w").alias("weight"), F.sum("_a").alias("coverage"))


def lattice_index(k: Column, length: Column, count: Column) -> Column:
    """The k-th of `count` indices spread evenly from 0 to length - 1, halves to the even index, in whole numbers only."""
    k, length, d = k.cast("long"), length.cast("long"), F.greatest(count.cast("long") - 1, F.lit(1))
    n = k * (length - 1)
    q, rest = F.floor(F.try_divide(n - n % d, d)).cast("long"), n % d
    up = (2 * rest > d) | ((2 * rest == d) & (q % 2 == 1))
    return F.when(count <= 1, F.lit(0)).otherwise(q + up.cast("long"))


def sample_lattice(images: DataFrame, keys: list[str], height: str, width: str, most: int) -> DataFrame:
    """(keys, y, x): at most about `most` evenly spread pixels of each image; it depends on the image's size alone."""
    h, w = F.col(height).cast("long"), F.col(width).cast("long")
    rows = F.least(h, F.greatest(F.lit(1), F.floor(F.sqrt(F.floor(most * h / F.greatest(F.lit(1), w))))))
    out = images.where((h > 0) & (w > 0)).select(*keys, h.alias("_h"), w.alias("_w"), rows.alias("_r")).withColumn("_c", F.least("_w", F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_r")))))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_r") - 1))).withColumn("y", lattice_index(F.col("_k"), F.col("_h"), F.col("_r")))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).withColumn("x", lattice_index(F.col("_k"), F.col("_w"), F.col("_c")))
    return out.select(*keys, "y", "x").distinct()


def largest_rectangle(cells: DataFrame, keys: list[str], x: str, y: str, valid: Column) -> DataFrame:
    """(keys, area, y0, x0, y1, x1): the largest rectangle of valid cells (ends exclusive); of equal ones the greatest (y0, x0, y1, x1).

    Heights of valid runs come from a window down each column; each cell's height then spans the columns
    on both sides up to the next lower one.  Work per row of cells, so a row's width bounds a task.
    """
    rows = cells.where(F.coalesce(valid, F.lit(False))).select(*keys, F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y")).distinct()
    down = Window.partitionBy(*keys, "x").orderBy("y")
    rows = rows.withColumn("_run", F.col("y") - F.row_number().over(down))
    rows = rows.withColumn("h", F.row_number().over(Window.partitionBy(*keys, "x", "_run").orderBy("y")).cast("int"))
    lines = rows.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x", "h"))).alias("line"))

    def spans(line: list[dict]) -> tuple[int, int, int, int]:
        """(area, height, left, right) of the best rectangle that ends in this row."""
        best, open_ = (0, 0, 0, 0), []
        places = [(c["x"], c["h"]) for c in line]
        closed = [p for i, p in enumerate(places) for p in ([(places[i - 1][0] + 1, 0), p] if i and places[i - 1][0] + 1 < p[0] else [p])]
        for at, height in [*closed, (places[-1][0] + 1, 0)]:
            left = at
            while open_ and open_[-1][1] >= height:
                left, tall = open_.pop()
                best = max(best, (tall * (at - left), -tall, left, at))
            open_.append((left, height))
        return best

    def run(batches):
        for batch in batches:
            found = [spans(line) for line in batch["line"].to_pylist()]
            own = [batch[k] for k in (*keys, "y")]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([f[i] for f in found], pa.int32()) for i in range(4)]], [*keys, "y", "area", "h", "x0", "x1"])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    out = lines.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in (*keys, "y")], "area int, h int, x0 int, x1 int"]))
    box = F.struct("area", (F.col("y") + F.col("h") + 1).alias("y0"), "x0", (F.col("y") + 1).alias("y1"), "x1")
    return out.groupBy(*keys).agg(F.max(box).alias("b")).select(*keys, "b.area", "b.y0", "b.x0", "b.y1", "b.x1")


def channel_medians(pixels: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """(keys, place, n, median) of the four places of a 2 x 2 colour mosaic, row by row."""
    v = clean(value)
    return pixels.groupBy(*keys, (F.pmod(F.col(y), F.lit(2)) * 2 + F.pmod(F.col(x), F.lit(2))).cast("int").alias("place")).agg(F.count(v).alias("n"), F.percentile(v, F.lit(0.5)).alias("median"))
