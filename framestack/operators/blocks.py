"""Images in square blocks, and what reaches over their borders: warps, connected labels, apertures.

A block has (keys, by, bx, data): side x side values row by row, NaN where the image has none, of the block whose first
pixel is (by * side, bx * side).  A task holds one output block and the source blocks its window touches, never an image.
Windows, links and sums are DataFrame code; numpy only fills in a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import components, cut

#: Pixels of a block's side.
SIDE = 256
#: Pixels that a Lanczos-3 sample reads on each side, and those that must exist (fixed values).
REACH, MARGIN = 3, 2


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)


def _small_batches(df: DataFrame) -> DataFrame:
    """df, after a batch of blocks is bounded by its bytes: ten thousand rows of blocks would be gigabytes in a Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def from_pixels(pixels: DataFrame, keys: list[str], y: str, x: str, value: str, side: int = SIDE, kind: str = "<f8") -> DataFrame:
    """Blocks of pixel rows, each pixel once; of repeated ones the greatest value counts, negative positions are left out."""
    rows = pixels.where((F.col(y) >= 0) & (F.col(x) >= 0)).select(*keys, F.floor(F.col(y) / side).cast("int").alias("by"), F.floor(F.col(x) / side).cast("int").alias("bx"), (F.col(y) % side * side + F.col(x) % side).cast("int").alias("_at"), F.col(value).cast("double").alias("_v"))

    def run(table: pa.Table) -> pa.Table:
        data = np.full(side * side, np.nan)
        np.fmax.at(data, table["_at"].to_numpy(), table["_v"].to_numpy(zero_copy_only=False).astype(float))
        return table.slice(0, 1).select([*keys, "by", "bx"]).append_column("data", pa.array([data.astype(kind).tobytes()], pa.binary()))

    return rows.groupBy(*keys, "by", "bx").applyInArrow(run, f"{_kinds(rows, [*keys, 'by', 'bx'])}, data binary")


def from_sparse(pixels: DataFrame, images: DataFrame, keys: list[str], y: str, x: str, value: str, side: int = SIDE) -> DataFrame:
    """Blocks of whole images (keys, height, width) of which pixel rows give the means of some pixels; the others are 0, no row is made of them.

    Rows of a pixel repeat; those without a value count nothing.  One shuffle brings the rows of a block together.
    """
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    rows = pixels.where((F.col(y) >= 0) & (F.col(x) >= 0)).select(*keys, at(y).alias("by"), at(x).alias("bx"), (F.col(y) % side * side + F.col(x) % side).cast("int").alias("_at"), F.col(value).cast("double").alias("_v"))
    count = lambda c: F.ceil(F.col(c) / side) - 1
    # A long row of blocks is counted up in two steps, so that no array grows with the image.
    tall = images.where("height > 0 and width > 0").withColumn("by", F.explode(F.sequence(F.lit(0).cast("long"), count("height"))))
    far = tall.withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(count("width") / 4096)))).withColumn("bx", F.explode(F.sequence(F.col("_x") * 4096, F.least(F.col("_x") * 4096 + 4095, count("width")))))
    marks = far.select(*keys, F.col("by").cast("int").alias("by"), F.col("bx").cast("int").alias("bx"), (-F.least(F.lit(side), F.col("height") - F.col("by") * side) * (side + 1) - F.least(F.lit(side), F.col("width") - F.col("bx") * side)).cast("int").alias("_at"), F.lit(None).cast("double").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, own, size = np.zeros(side * side), np.zeros(side * side), None, None
        for batch in batches:
            own = batch.slice(0, 1).select([*keys, "by", "bx"]) if own is None and batch.num_rows else own
            place, known = batch["_at"].to_numpy(), batch["_v"].is_valid().to_numpy(zero_copy_only=False)
            if (place < 0).any():
                size = divmod(-int(place.min()), side + 1)
            known &= place >= 0
            v = batch["_v"].to_numpy(zero_copy_only=False)[known]
            total += np.bincount(place[known], v, side * side)
            n += np.bincount(place[known], minlength=side * side)
        if size:
            data = np.full((side, side), np.nan)
            mean = np.divide(total, n, out=np.zeros(side * side), where=n > 0).reshape(side, side)
            data[: size[0], : size[1]] = mean[: size[0], : size[1]]
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([data.astype("<f8").tobytes()], pa.binary())], [*keys, "by", "bx", "data"])

    return rows.unionByName(marks).groupBy(*keys, "by", "bx").applyInArrow(run, f"{_kinds(rows, [*keys, 'by', 'bx'])}, data binary")


def from_bands(bands: DataFrame, keys: list[str], side: int = SIDE, kind: str = "<f4") -> DataFrame:
    """Blocks of row bands (keys, y0, rows, width, data) that lie within one row of blocks each; no shuffle where bands are `side` high."""
    schema = f"{_kinds(bands, keys)}, by int, bx int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.select(["y0", "rows", "width", "data"]).to_pylist()):
                by, first = divmod(r["y0"], side)
                if first or r["rows"] > side:
                    raise ValueError(f"a band from row {r['y0']} with {r['rows']} rows is not one of {side} rows")
                band = np.full((side, -(-r["width"] // side) * side), np.nan, kind)
                band[: r["rows"], : r["width"]] = np.frombuffer(r["data"], kind).reshape(r["rows"], r["width"])
                n = band.shape[1] // side
                own = [batch.column(k).take(pa.array([i] * n)) for k in keys]
                data = pa.array([np.ascontiguousarray(band[:, side * c : side * c + side]).tobytes() for c in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, pa.array([by] * n, pa.int32()), pa.array(range(n), pa.int32()), data], [*keys, "by", "bx", "data"])

    return bands.select(*keys, "y0", "rows", "width", "data").mapInArrow(run, schema)


def to_pixels(blocks: DataFrame, keys: list[str], side: int = SIDE, kind: str = "<f8", name: str = "value") -> DataFrame:
    """(keys, y, x, value) of the finite pixels (of integer blocks: those that aren't negative)."""
    whole = np.dtype(kind).kind == "i"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.select(["by", "bx", "data"]).to_pylist()):
                v = np.frombuffer(r["data"], kind)
                at = np.nonzero(v >= 0 if whole else np.isfinite(v))[0]
                own = [batch.column(k).take(pa.array(np.full(len(at), i))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at // side + r["by"] * side, pa.int64()), pa.array(at % side + r["bx"] * side, pa.int64()), pa.array(v[at].astype("<i8" if whole else "<f8"))], [*keys, "y", "x", name])

    return _small_batches(blocks).select(*keys, "by", "bx", "data").mapInArrow(run, f"{_kinds(blocks, keys)}, y bigint, x bigint, `{name}` {'bigint' if whole else 'double'}")


def inverse(m: Column) -> Column:
    """The inverse of a matrix (9 doubles, by rows); null where it has none."""
    a, b, c, d, e, f, g, h, i = [F.get(m, F.lit(k)) for k in range(9)]
    parts = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    det = a * parts[0] + b * parts[3] + c * parts[6]
    return F.when(det != 0, F.array(*[p / det for p in parts]))


def seen(m: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """A point through a matrix: x, y and the divisor."""
    a = [F.get(m, F.lit(k)) for k in range(9)]
    d = a[6] * x + a[7] * y + a[8]
    return (a[0] * x + a[1] * y + a[2]) / d, (a[3] * x + a[4] * y + a[5]) / d, d


def _reached(low: Column, high: Column, length: Column, side: int) -> tuple[Column, Column]:
    """First and last block that samples between two positions read."""
    first = F.greatest(F.floor(low) - REACH, F.lit(0))
    last = F.least(F.ceil(high) + REACH, length - 1)
    return F.floor(first / side).cast("int"), F.floor(last / side).cast("int")


def matrix_windows(images: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """(keys, ty, tx, out_height, out_width, height, width, m, nodes, y_first, y_last, x_first, x_last): the source blocks each output block reads.

    Images have (keys, height, width, out_height, out_width, m); m takes output to input.  The corners of a block bound what
    it sees, unless the divisor changes its sign within it: then it reads the whole image.
    """
    count = lambda c: F.sequence(F.lit(0), F.ceil(F.col(c) / side).cast("int") - 1)
    some = images.where("out_height > 0 and out_width > 0 and height > 0 and width > 0").select(*keys, "height", "width", "out_height", "out_width", "m")
    tiles = some.withColumn("ty", F.explode(count("out_height"))).withColumn("tx", F.explode(count("out_width")))
    ys = [F.col("ty") * side, F.least(F.col("ty") * side + side, "out_height") - 1]
    xs = [F.col("tx") * side, F.least(F.col("tx") * side + side, "out_width") - 1]
    corners = [F.struct(*[c.alias(n) for c, n in zip(seen(F.col("m"), x.cast("double"), y.cast("double")), "xyd")]) for y in ys for x in xs]
    tiles = tiles.withColumn("_c", F.array(*corners))
    sound = F.forall("_c", lambda c: c.d > 0) | F.forall("_c", lambda c: c.d < 0)

    def ends(axis: str, length: str) -> tuple[Column, Column]:
        v = F.transform("_c", lambda c: c[axis])
        low, high = _reached(F.when(sound, F.array_min(v)).otherwise(F.lit(0.0)), F.when(sound, F.array_max(v)).otherwise(F.col(length).cast("double")), F.col(length), side)
        return low.alias(f"{axis}_first"), high.alias(f"{axis}_last")

    nodes = F.lit(None).cast("array<struct<ny:int,nx:int,sx:double,sy:double>>").alias("nodes")
    return tiles.select(*keys, "ty", "tx", "out_height", "out_width", "height", "width", "m", nodes, *ends("y", "height"), *ends("x", "width"))


def lattice_windows(images: DataFrame, nodes: DataFrame, keys: list[str], spacing: int, side: int = SIDE) -> DataFrame:
    """matrix_windows() through a lattice: node (ny, nx) holds the input position (sx, sy) of output pixel (nx * spacing, ny * spacing).

    `side` is a multiple of `spacing`.  With a matrix m the node positions go through it as well, so that canvas to reference
    to frame is one interpolation.  Blocks without nodes give no row; pixels beyond the nodes are null.
    """
    if side % spacing:
        raise ValueError("the block's side must be a multiple of the spacing")
    n = side // spacing
    met = nodes.select(*keys, F.col("ny").cast("int").alias("ny"), F.col("nx").cast("int").alias("nx"), F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy")).join(images.select(*keys, "height", "width", "out_height", "out_width", "m"), keys)
    x, y, _ = seen(F.col("m"), F.col("sx"), F.col("sy"))
    met = met.withColumns({"sx": F.when(F.col("m").isNull(), F.col("sx")).otherwise(x), "sy": F.when(F.col("m").isNull(), F.col("sy")).otherwise(y)})
    # A node on a block's border belongs to both blocks: its cells end there.
    touched = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - 1) / n), F.floor(F.col(c) / n)))
    dealt = met.withColumn("ty", F.explode(touched("ny"))).withColumn("tx", F.explode(touched("nx")))
    dealt = dealt.where((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * side < F.col("out_height")) & (F.col("tx") * side < F.col("out_width")))
    own = [*keys, F.col("ty").cast("int").alias("ty"), F.col("tx").cast("int").alias("tx"), "out_height", "out_width", "height", "width"]
    # Lists are made once the nodes of a block are together, not in part by the tasks that deal them.
    dealt = dealt.select(*own, "ny", "nx", "sx", "sy").repartition(*keys, "ty", "tx")
    tiles = dealt.groupBy(*keys, "ty", "tx", "out_height", "out_width", "height", "width").agg(F.collect_list(F.struct("ny", "nx", "sx", "sy")).alias("nodes"), *[f(c).alias(f"{n}_{c}") for c in ("sx", "sy") for f, n in ((F.min, "low"), (F.max, "high"))])
    (y0, y1), (x0, x1) = _reached(F.col("low_sy"), F.col("high_sy"), F.col("height"), side), _reached(F.col("low_sx"), F.col("high_sx"), F.col("width"), side)
    return tiles.select(*keys, "ty", "tx", "out_height", "out_width", "height", "width", F.lit(None).cast("array<double>").alias("m"), "nodes", y0.alias("y_first"), y1.alias("y_last"), x0.alias("x_first"), x1.alias("x_last"))


def taps(fraction: np.ndarray) -> np.ndarray:
    """Weights of the six neighbours -2 .. 3, summing to one; whole positions weigh their own pixel alone."""
    t = fraction[None] - np.arange(-2, 4).reshape(-1, *[1] * fraction.ndim)
    w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    w = np.where((t == np.rint(t)) & (t != 0), 0.0, w)
    return w / w.sum(0)


def sample(window: np.ndarray, sx: np.ndarray, sy: np.ndarray, top: int, left: int, height: int, width: int, domain: float | None, linear: bool = False) -> np.ndarray:
    """Samples of an image of which `window` holds the part from (top, left) on; NaN where a needed pixel is missing.

    Lanczos-3 stays within the range of the six by six pixels it reads, widened to 0 .. domain.
    """
    far = 0 if linear else MARGIN
    with np.errstate(invalid="ignore"):
        ok = np.isfinite(sx) & np.isfinite(sy) & (sx >= far) & (sx <= width - 1 - far) & (sy >= far) & (sy <= height - 1 - far)
    out = np.full(sx.shape, np.nan)
    x, y = sx[ok], sy[ok]
    fx, fy = np.floor(x), np.floor(y)
    reach = range(2) if linear else range(-2, 4)
    wx = np.stack([1 - (x - fx), x - fx]) if linear else taps(x - fx)
    wy = np.stack([1 - (y - fy), y - fy]) if linear else taps(y - fy)
    total, low, high = np.zeros(len(x)), np.full(len(x), np.inf), np.full(len(x), -np.inf)
    sound = np.ones(len(x), bool)
    ix, iy = fx.astype(int) - left, fy.astype(int) - top
    for j, b in zip(reach, wy):
        for i, a in zip(reach, wx):
            w = a * b
            # A pixel beyond the window has no weight wherever the sample is valid.
            v = window[np.clip(iy + j, 0, window.shape[0] - 1), np.clip(ix + i, 0, window.shape[1] - 1)]
            used = w != 0
            finite = np.isfinite(v)
            sound &= finite | ~used
            held = np.where(used & finite, v, 0.0)
            total += w * held
            low, high = np.where(used & finite, np.minimum(low, v), low), np.where(used & finite, np.maximum(high, v), high)
    if not linear:
        total = np.clip(total, np.minimum(low, 0.0) if domain is not None else low, np.maximum(high, domain) if domain is not None else high)
    out[ok] = np.where(sound, total, np.nan)
    return out


def copied(m: np.ndarray) -> bool:
    """Whether a matrix moves no pixel between others: the identity, or a half turn by whole pixels."""
    turn = np.array_equal(m[:2, :2], np.eye(2)) and not m[:2, 2].any() or np.allclose(m[:2, :2], -np.eye(2), rtol=0, atol=2e-15) and np.allclose(m[:2, 2], np.rint(m[:2, 2]), rtol=2e-15, atol=2e-15)
    return bool(turn and np.array_equal(m[2], (0.0, 0.0, 1.0)))


def warp(blocks: DataFrame, windows: DataFrame, keys: list[str], side: int = SIDE, kind: str = "<f8", domain: float | None = None, linear: bool = False, spacing: int | None = None) -> DataFrame:
    """Blocks (keys, by, bx, data) of the warped images; windows come from matrix_windows(), or from lattice_windows() of that `spacing`.

    A source block goes to every output block whose window touches it: one join on (keys, by, bx) and one shuffle of output
    blocks.  A group holds the window of one output block, of about (side * scale * sqrt 2 + 6) squared pixels.  Identities and half
    turns copy all pixels; else a sample needs its whole support within the image.  Images without blocks come out empty.
    """
    spread = lambda a, b: F.when((F.col(a) <= F.col(b)) & (F.col(b) >= 0), F.sequence(F.col(a), F.col(b)))
    dealt = windows.withColumn("by", F.explode_outer(spread("y_first", "y_last"))).withColumn("bx", F.explode_outer(spread("x_first", "x_last")))
    # Windows come from a few rows of images, blocks from files: neither is as small as it looks, so neither may be broadcast.
    met = dealt.join(blocks.select(*keys, "by", "bx", "data").hint("merge"), [*keys, "by", "bx"], "left")

    def run(table: pa.Table) -> pa.Table:
        r = table.slice(0, 1).to_pylist()[0]
        y0, x0 = r["ty"] * side, r["tx"] * side
        y, x = np.mgrid[y0 : y0 + side, x0 : x0 + side].astype(float)
        copy = False
        if r["nodes"] is not None:
            sx, sy = _between_nodes(r["nodes"], y, x, spacing)
        else:
            m = np.array(r["m"] if r["m"] is not None else [np.nan] * 9, float).reshape(3, 3)
            copy = copied(m)
            with np.errstate(all="ignore"):
                d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
                sx, sy = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d
            if copy:
                sx, sy = np.rint(sx), np.rint(sy)
        outside = (y >= r["out_height"]) | (x >= r["out_width"])
        sx, sy = np.where(outside, np.nan, sx), np.where(outside, np.nan, sy)
        parts = [p for p in table.select(["by", "bx", "data"]).to_pylist() if p["data"] is not None]
        out = np.full((side, side), np.nan)
        if parts:
            top, left = min(p["by"] for p in parts), min(p["bx"] for p in parts)
            window = np.full(((max(p["by"] for p in parts) - top + 1) * side, (max(p["bx"] for p in parts) - left + 1) * side), np.nan)
            for p in parts:
                a, b = (p["by"] - top) * side, (p["bx"] - left) * side
                window[a : a + side, b : b + side] = np.frombuffer(p["data"], kind).reshape(side, side)
            # Pixels of blocks that do not exist must not be taken from the window's rim.
            window = np.pad(window, REACH, constant_values=np.nan)
            with np.errstate(invalid="ignore"):
                far = (sx < left * side) | (sx > left * side + window.shape[1] - 2 * REACH - 1) | (sy < top * side) | (sy > top * side + window.shape[0] - 2 * REACH - 1)
            out = sample(window, np.where(far, np.nan, sx), sy, top * side - REACH, left * side - REACH, r["height"], r["width"], domain, linear or copy)
        own = table.slice(0, 1).select([*keys, "ty", "tx"]).rename_columns([*keys, "by", "bx"])
        return own.append_column("data", pa.array([out.astype(kind).tobytes()], pa.binary()))

    return met.groupBy(*keys, "ty", "tx").applyInArrow(run, f"{_kinds(met, keys)}, by int, bx int, data binary")


def _between_nodes(nodes: list[dict], y: np.ndarray, x: np.ndarray, spacing: int) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear between nodes; a position on a node's row or column needs no node beyond it."""
    ny, nx = np.array([n["ny"] for n in nodes]), np.array([n["nx"] for n in nodes])
    grid = np.full((2, ny.max() - ny.min() + 2, nx.max() - nx.min() + 2), np.nan)
    grid[0, ny - ny.min(), nx - nx.min()] = [n["sx"] for n in nodes]
    grid[1, ny - ny.min(), nx - nx.min()] = [n["sy"] for n in nodes]
    cy, cx = (y // spacing).astype(int) - ny.min(), (x // spacing).astype(int) - nx.min()
    fy, fx = y % spacing / spacing, x % spacing / spacing
    known = (cy >= 0) & (cx >= 0) & (cy < grid.shape[1] - 1) & (cx < grid.shape[2] - 1)
    cy, cx = np.where(known, cy, 0), np.where(known, cx, 0)

    def between(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.where(f == 0, a, a + f * (b - a))

    out = [np.where(known, between(between(g[cy, cx], g[cy, cx + 1], fx), between(g[cy + 1, cx], g[cy + 1, cx + 1], fx), fy), np.nan) for g in grid]
    return out[0], out[1]


def local_labels(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """The first position (row by row) of each pixel's connected part, -1 outside the mask."""
    start = mask & ~np.pad(mask, ((0, 0), (1, 0)))[:, :-1]
    run = np.cumsum(start).reshape(mask.shape) - 1
    steps = (-1, 0, 1) if diagonal else (0,)
    pairs = []
    for s in steps:
        up, down = (slice(None, -1), slice(max(0, -s), mask.shape[1] - max(0, s))), (slice(1, None), slice(max(0, s), mask.shape[1] - max(0, -s)))
        both = mask[up] & mask[down]
        pairs.append(np.stack([run[up][both], run[down][both]]))
    a, b = np.unique(np.concatenate(pairs, 1), axis=1)
    least = np.arange(start.sum())
    while True:
        m = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    first = np.flatnonzero(start)
    return np.where(mask, first[least[np.where(mask, run, 0)]], -1) if len(first) else np.full(mask.shape, -1)


def _masked(data: bytes, kind: str, side: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(data, kind).reshape(side, side).astype(float)
    with np.errstate(invalid="ignore"):
        return v, np.isfinite(v) & (v > level)


#: A label holds the row and column of its first pixel: row * COLUMNS + column.
COLUMNS = 1 << 31


def label_parts(blocks: DataFrame, keys: list[str], level: float, side: int = SIDE, kind: str = "<f8", diagonal: bool = False) -> DataFrame:
    """(keys, by, bx, part, n, y0, x0, y1, x1, total, peak, rim): the connected parts of values above the level, block by block.

    `rim` holds a part's pixels on the block's border, at most 4 * side of them over all parts of a block.
    """
    fields = "by int, bx int, part bigint, n bigint, y0 bigint, x0 bigint, y1 bigint, x1 bigint, total double, peak double, rim array<struct<y:bigint,x:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rim_type = pa.list_(pa.struct([("y", pa.int64()), ("x", pa.int64())]))
        for batch in batches:
            for k, r in enumerate(batch.select(["by", "bx", "data"]).to_pylist()):
                v, mask = _masked(r["data"], kind, side, level)
                if not mask.any():
                    continue
                lab = local_labels(mask, diagonal)
                y, x = np.nonzero(mask)
                parts, at = np.unique(lab[mask], return_inverse=True)
                Y, X, c = y + r["by"] * side, x + r["bx"] * side, len(parts)
                n, total = np.bincount(at, minlength=c), np.bincount(at, v[mask], c)
                ends = []
                for f, start, what in ((np.minimum, 1 << 62, Y), (np.minimum, 1 << 62, X), (np.maximum, -1, Y), (np.maximum, -1, X)):
                    e = np.full(c, start, np.int64)
                    f.at(e, at, what)
                    ends.append(e)
                peak = np.full(c, -np.inf)
                np.maximum.at(peak, at, v[mask])
                edge = (y == 0) | (x == 0) | (y == side - 1) | (x == side - 1)
                rims: list[list[dict]] = [[] for _ in range(c)]
                for g, py, px in zip(at[edge], Y[edge], X[edge]):
                    rims[g].append({"y": int(py), "x": int(px)})
                ids = (parts // side + r["by"] * side) * COLUMNS + parts % side + r["bx"] * side
                own = [batch.column(q).take(pa.array(np.full(c, k))) for q in keys]
                cols = [pa.array(np.full(c, r["by"]), pa.int32()), pa.array(np.full(c, r["bx"]), pa.int32()), *[pa.array(a, pa.int64()) for a in (ids, n, *ends)], pa.array(total), pa.array(peak), pa.array(rims, rim_type)]
                yield pa.RecordBatch.from_arrays([*own, *cols], [*keys, *[f.split()[0] for f in fields.split(", ")]])

    return _small_batches(blocks).select(*keys, "by", "bx", "data").mapInArrow(run, f"{_kinds(blocks, keys)}, {fields}")


def label_points(pixels: DataFrame, keys: list[str], y: str, x: str, value: str, level: float, side: int = SIDE, diagonal: bool = False, tasks: int | None = None) -> DataFrame:
    """label_parts() of from_pixels(), for images with few pixels above the level: work follows the pixels, not the blocks' area.

    Pixels are dealt by block and read in order, whole blocks of a batch at once; neighbours are found by their places.
    """
    v = F.col(value).cast("double")
    own = pixels.where((F.col(y) >= 0) & (F.col(x) >= 0) & v.isNotNull() & ~F.isnan(v))
    own = own.select(*keys, F.floor(F.col(y) / side).cast("int").alias("by"), F.floor(F.col(x) / side).cast("int").alias("bx"), (F.col(y) % side * side + F.col(x) % side).cast("int").alias("_at"), v.alias("_v"))
    block = [*keys, "by", "bx"]
    own = own.repartition(tasks, *block) if tasks else own.repartition(*block)
    rows = own.groupBy(*block, "_at").agg(F.max("_v").alias("_v")).where((F.col("_v") > level) & (F.col("_v") < float("inf"))).sortWithinPartitions(*block, "_at")
    fields = "by int, bx int, part bigint, n bigint, y0 bigint, x0 bigint, y1 bigint, x1 bigint, total double, peak double, rim array<struct<y:bigint,x:bigint>>"
    steps = [(0, 1), (1, 0), *([(1, -1), (1, 1)] if diagonal else [])]

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in (t[k].combine_chunks() for k in block):
            a, b = c[1:], c[:-1]
            new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        return new

    def answer(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        at, v, by, bx = (t[c].to_numpy() for c in ("_at", "_v", "by", "bx"))
        py, px = at // side, at % side
        place = (np.cumsum(new) - 1) * side * side + at  # ascending
        pairs = []
        for dy, dx in steps:
            inside = np.flatnonzero((py + dy < side) & (px + dx >= 0) & (px + dx < side))
            there = np.searchsorted(place, place[inside] + dy * side + dx)
            met = there < len(place)
            met[met] = place[there[met]] == (place[inside] + dy * side + dx)[met]
            pairs.append(np.stack([inside[met], there[met]]))
        a, b = np.concatenate(pairs, 1)
        least, was = np.arange(len(place)), None
        while was is None or not np.array_equal(least, was):
            was, m = least.copy(), np.minimum(least[a], least[b])
            np.minimum.at(least, least[a], m)
            np.minimum.at(least, least[b], m)
            least = least[least]
        first, part = np.unique(least, return_inverse=True)
        order = np.argsort(part, kind="stable")
        edges = np.concatenate(([0], np.cumsum(np.bincount(part))[:-1]))
        Y, X = py.astype(np.int64) + by.astype(np.int64) * side, px.astype(np.int64) + bx.astype(np.int64) * side
        over = lambda f, c: f.reduceat(c[order], edges)
        ends = [over(np.minimum, Y), over(np.minimum, X), over(np.maximum, Y), over(np.maximum, X)]
        edge = ((py == 0) | (px == 0) | (py == side - 1) | (px == side - 1))[order]
        rims = np.concatenate(([0], np.cumsum(np.bincount(part[order][edge], minlength=len(first))))).astype(np.int32)
        rim = pa.ListArray.from_arrays(pa.array(rims), pa.StructArray.from_arrays([pa.array(Y[order][edge]), pa.array(X[order][edge])], ["y", "x"]))
        named = t.select(block).take(pa.array(first)).combine_chunks().columns
        cols = [Y[first] * COLUMNS + X[first], np.bincount(part), *ends, np.bincount(part, v), over(np.maximum, v)]
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in named], *[pa.array(c) for c in cols], rim], [*keys, *[f.split()[0] for f in fields.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            if not held.num_rows:
                continue
            new = starts(held)
            last = int(np.flatnonzero(new)[-1])  # a block that may go on in the next batch, of side * side pixels at most
            if last:
                yield answer(held.slice(0, last), new[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield answer(held, starts(held))

    return rows.mapInArrow(run, f"{_kinds(rows, keys)}, {fields}")


def joined_parts(parts: DataFrame, keys: list[str], diagonal: bool = False) -> DataFrame:
    """label_parts() with `label`, the least part that is connected over block borders: an equi-join of rim pixels with their neighbours, then components."""
    parts = cut(parts)
    rim = parts.select(*keys, "by", "bx", "part", F.explode("rim").alias("p")).select(*keys, "by", "bx", "part", "p.y", "p.x")
    steps = [(0, 1), (1, 0), *([(1, -1), (1, 1)] if diagonal else [])]
    there = rim.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
    there = there.select(*keys, F.col("by").alias("_by"), F.col("bx").alias("_bx"), F.col("part").alias("_other"), (F.col("y") + F.col("_s.a")).alias("y"), (F.col("x") + F.col("_s.b")).alias("x"))
    # Null keys are one image; a join on a struct of them must say so.
    image = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_"))
    a, b = rim.select(image.alias("_i"), "by", "bx", "part", "y", "x"), there.select(image.alias("_i"), "_by", "_bx", "_other", "y", "x")
    met = a.join(b, ["_i", "y", "x"]).where("by <> _by or bx <> _bx")
    node = lambda c: F.struct(F.col("_i").alias("i"), F.col(c).alias("p"))
    found = components(met.select(node("part").alias("u"), node("_other").alias("v")))
    least = found.select(F.col("node").alias("_node"), F.col("component.p").alias("_least"))
    tied = parts.withColumn("_node", F.struct(image.alias("i"), F.col("part").alias("p"))).join(least, "_node", "left")
    return tied.withColumn("label", F.coalesce("_least", "part")).select(*parts.columns, "label")


def regions(joined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, y, x, n, y0, x0, y1, x1, total, peak) of whole labels; (y, x) is the first pixel, box ends are inclusive."""
    sums = joined.groupBy(*keys, "label").agg(F.sum("n").alias("n"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"), F.sum("total").alias("total"), F.max("peak").alias("peak"))
    return sums.select(*keys, "label", F.floor(F.col("label") / COLUMNS).alias("y"), (F.col("label") % COLUMNS).alias("x"), "n", "y0", "x0", "y1", "x1", "total", "peak")


def label_blocks(blocks: DataFrame, joined: DataFrame, keys: list[str], level: float, side: int = SIDE, kind: str = "<f8", diagonal: bool = False, least: int = 1) -> DataFrame:
    """Blocks (keys, by, bx, data) of 64-bit labels, -1 outside and in regions of fewer than `least` pixels."""
    sizes = regions(joined, keys).where(F.col("n") >= least).select(*keys, "label")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    held = joined.alias("a").join(sizes.alias("b"), [*same, F.col("a.label") == F.col("b.label")]).select(*[F.col(f"a.{k}") for k in keys], "by", "bx", "part", F.col("a.label"))
    maps = held.groupBy(*keys, "by", "bx").agg(F.collect_list(F.struct("part", "label")).alias("_map"))  # parts of one block
    on = [*[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.col("a.by") == F.col("b.by"), F.col("a.bx") == F.col("b.bx")]
    met = blocks.alias("a").join(maps.alias("b"), on, "left").select(*[F.col(f"a.{k}") for k in keys], F.col("a.by"), F.col("a.bx"), "data", "_map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["by", "bx", "data", "_map"]).to_pylist():
                lab = local_labels(_masked(r["data"], kind, side, level)[1], diagonal)
                known = {p["part"]: p["label"] for p in r["_map"] or []}
                ids, at = np.unique(lab, return_inverse=True)
                full = [known.get((int(i) // side + r["by"] * side) * COLUMNS + int(i) % side + r["bx"] * side, -1) if i >= 0 else -1 for i in ids]
                out.append(np.array(full, "<i8")[at.ravel()].tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*keys, "by", "bx")], pa.array(out, pa.binary())], [*keys, "by", "bx", "data"])

    return _small_batches(met).mapInArrow(run, f"{_kinds(met, keys)}, by int, bx int, data binary")


def apertures(stars: DataFrame, blocks: DataFrame, keys: list[str], star: str, x: str, y: str, radius: float, inner: float, outer: float, side: int = SIDE, kind: str = "<f8") -> DataFrame:
    """(keys, star, n, background, flux): sums within `radius` less the mean of a ring from `inner` to `outer` around each star.

    A pixel counts where its centre does.  Stars go to the blocks their ring touches; partial sums of blocks combine.  The flux
    is null where pixels of the aperture are missing or the ring is empty; stars without a position are left out.
    """
    ends = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - outer) / side), F.lit(0)).cast("int"), F.greatest(F.floor((F.col(c) + outer) / side), F.lit(0)).cast("int"))
    sound = stars.select(*keys, F.col(star).alias("_star"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x = _x and _y = _y and abs(_x) < 1e9 and abs(_y) < 1e9")
    named = sound.groupBy(*keys, "_star").agg(F.min(F.struct("_y", "_x")).alias("_p")).select(*keys, "_star", "_p._x", "_p._y")
    dealt = named.withColumn("by", F.explode(ends("_y"))).withColumn("bx", F.explode(ends("_x")))
    lists = dealt.groupBy(*keys, "by", "bx").agg(F.collect_list(F.struct("_star", "_x", "_y")).alias("_stars"))  # stars of one block
    met = blocks.select(*keys, "by", "bx", "data").join(lists.hint("merge"), [*keys, "by", "bx"])
    kinds = f"{_kinds(blocks, keys)}, `_star` {stars.schema[star].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.select(["by", "bx", "data"]).to_pylist()):
                near = batch.column("_stars")[k].values
                sums = np.zeros((4, len(near)))
                v = np.frombuffer(r["data"], kind).reshape(side, side).astype(float)
                for i, (sx, sy) in enumerate(zip(near.field("_x").to_numpy(), near.field("_y").to_numpy())):
                    cx, cy = sx - r["bx"] * side, sy - r["by"] * side
                    y0, y1 = max(0, int(np.floor(cy - outer))), min(side, int(np.ceil(cy + outer)) + 1)
                    x0, x1 = max(0, int(np.floor(cx - outer))), min(side, int(np.ceil(cx + outer)) + 1)
                    if y0 >= y1 or x0 >= x1:
                        continue
                    part = v[y0:y1, x0:x1]
                    # Whole steps from the star's pixel less its own fraction, as in the count of needed centres: ties fall alike.
                    (iy, ix), (fy, fx) = np.floor((sy, sx)), (sy - np.floor(sy), sx - np.floor(sx))
                    d2 = (np.arange(y0, y1)[:, None] + (r["by"] * side - iy) - fy) ** 2 + (np.arange(x0, x1)[None] + (r["bx"] * side - ix) - fx) ** 2
                    known = np.isfinite(part)
                    disk, ring = known & (d2 < radius * radius), known & (d2 >= inner * inner) & (d2 < outer * outer)
                    sums[:, i] = disk.sum(), part[disk].sum(), ring.sum(), part[ring].sum()
                own = [batch.column(q).take(pa.array(np.full(len(near), k))) for q in keys]
                yield pa.RecordBatch.from_arrays([*own, near.field("_star"), *[pa.array(s) for s in sums]], [*keys, "_star", "_n", "_s", "_rn", "_rs"])

    sums = _small_batches(met).mapInArrow(run, f"{kinds}, `_n` double, `_s` double, `_rn` double, `_rs` double").groupBy(*keys, "_star").agg(*[F.sum(c).alias(c) for c in ("_n", "_s", "_rn", "_rs")])
    offsets = F.sequence(F.lit(-int(radius) - 1), F.lit(int(radius) + 1))
    # Centres that an aperture must hold, counted from the star's own fraction of a pixel.
    fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    need = F.aggregate(offsets, F.lit(0), lambda n, j: n + F.size(F.filter(offsets, lambda i: (j - fy) * (j - fy) + (i - fx) * (i - fx) < radius * radius)))
    out = named.withColumn("_need", need).join(sums.hint("merge"), [*keys, "_star"], "left")
    background = F.try_divide("_rs", "_rn")
    return out.select(*keys, F.col("_star").alias(star), F.coalesce(F.col("_n"), F.lit(0.0)).cast("long").alias("n"), background.alias("background"), F.when(F.col("_n") == F.col("_need"), F.col("_s") - F.col("_n") * background).alias("flux"))
