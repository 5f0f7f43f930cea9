"""Measurement of frame previews: background and noise, sources, and what a frame's gates need.

A preview has (frame, height, width, data little-endian float32) and a bounded size (sources.fits.previews).
The pixels of one are one task's numpy work; what follows from the moments (shapes, order, limits,
sums over frames) are DataFrame expressions.  NaN pixels take part in nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import MADN

# Detection in sigmas, least pixels of a source, least of them above without the filter, stars kept, cells of a grid.
SIGMA, LEAST_PIXELS, LEAST_SUPPORT, MOST_STARS, GRID = 4.5, 5, 3, 2500, 16
#: A part of a source is one of its own if it rises by this share of the source's flux peak over its saddle, and by three sigmas.
PART = 0.05
KERNEL = np.array([[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 1.0]])
STEPS = [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1) if j or i]


def _middle(v: np.ndarray) -> tuple[float, float]:
    med = float(np.median(v))
    return med, MADN * float(np.median(np.abs(v - med)))


def _mesh(length: int) -> int:
    return max(8, min(64, length // 4))


def _continued(cell: np.ndarray) -> np.ndarray:
    """The cells with one more on each side, on the line through the outer two; a single row or column repeats."""
    for axis in (0, 1):
        pad = [(1, 1) if k == axis else (0, 0) for k in (0, 1)]
        cell = np.pad(cell, pad, mode="reflect", reflect_type="odd") if cell.shape[axis] > 1 else np.pad(cell, pad, mode="edge")
    return cell


def background(image: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Background and noise of every pixel: clipped cell modes, median-filtered over cells, bilinear between their centres, linear beyond the outer ones."""
    h, w = image.shape
    ys, xs = np.arange(0, h, _mesh(h)), np.arange(0, w, _mesh(w))
    back, noise = np.full((len(ys), len(xs)), np.nan), np.full((len(ys), len(xs)), np.nan)
    for j, y in enumerate(ys):
        for i, x in enumerate(xs):
            box = np.s_[y : y + _mesh(h), x : x + _mesh(w)]
            v = image[box][valid[box]].astype(np.float64)
            if v.size < 0.5 * image[box].size:
                continue
            for _ in range(20):
                med, s = float(np.median(v)), float(v.std())
                kept = v[np.abs(v - med) <= 3 * s]
                if kept.size == v.size or not kept.size:
                    break
                v = kept
            mean, med, s = float(v.mean()), float(np.median(v)), float(v.std())
            # The mode of a crowded cell from its mean and median; the median where the two are far apart.
            back[j, i], noise[j, i] = 2.5 * med - 1.5 * mean if abs(mean - med) < 0.3 * s else med, s
    maps = []
    for cell in (back, noise):
        cell = np.where(np.isfinite(cell), cell, np.nanmedian(cell) if np.isfinite(cell).any() else 0.0)
        if min(cell.shape) >= 3:
            wide = _continued(cell)
            cell = np.median([wide[1 + j : wide.shape[0] - 1 + j, 1 + i : wide.shape[1] - 1 + i] for j, i in [*STEPS, (0, 0)]], axis=0)
        wide = _continued(cell)
        cy, cx = (np.minimum(ys + _mesh(h), h) + ys - 1) / 2, (np.minimum(xs + _mesh(w), w) + xs - 1) / 2
        cy, cx = (np.r_[2 * c[0] - c[1] if len(c) > 1 else c[0] - 1, c, 2 * c[-1] - c[-2] if len(c) > 1 else c[0] + 1] for c in (cy, cx))
        rows = np.stack([np.interp(np.arange(w), cx, line) for line in wide])
        full = np.stack([np.interp(np.arange(h), cy, column) for column in rows.T], axis=1)
        maps.append(full)
    maps[1] = np.clip(maps[1], noise[np.isfinite(noise)].min(initial=np.inf) if np.isfinite(noise).any() else 0.0, None)
    return maps[0], maps[1]


def _filtered(residual: np.ndarray, noise: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Signal to noise of the best fit of the kernel about every pixel."""
    h, w = residual.shape
    weight = np.pad(np.where(valid, 1 / noise**2, 0), 1)
    value = np.pad(np.where(valid, residual, 0), 1) * weight
    top, low = np.zeros((h, w)), np.zeros((h, w))
    for j in range(3):
        for i in range(3):
            top += KERNEL[j, i] * value[j : j + h, i : i + w]
            low += KERNEL[j, i] ** 2 * weight[j : j + h, i : i + w]
    return np.where(low > 0, top / np.sqrt(np.where(low > 0, low, 1)), 0)


def segments(snr: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Source number of every pixel above the threshold, 0 elsewhere: each climbs to its peak, and low parts join the neighbour over their highest saddle."""
    h, w = snr.shape
    mask = np.pad(snr > sigma, 1)
    v = np.pad(snr, 1)
    at = np.flatnonzero(mask)
    flat, size = v.ravel(), w + 2
    up = at.copy()
    for j, i in STEPS:
        other = at + j * size + i
        better = mask.ravel()[other] & ((flat[other] > flat[up]) | ((flat[other] == flat[up]) & (other < up)))
        up = np.where(better, other, up)
    parent = np.zeros(flat.size, np.int64)
    parent[at] = up
    while True:
        far = parent[parent[at]]
        if np.array_equal(far, parent[at]):
            break
        parent[at] = far
    # Saddles: of two touching pixels with different peaks, the lower one; the highest of each pair of peaks counts.
    saddle: dict[tuple[int, int], float] = {}
    for j, i in STEPS[4:]:
        other = at + j * size + i
        apart = mask.ravel()[other] & (parent[at] != parent[other])
        for a, b, s in zip(parent[at[apart]], parent[other[apart]], np.minimum(flat[at[apart]], flat[other[apart]])):
            pair = (min(a, b), max(a, b))
            saddle[pair] = max(saddle.get(pair, -np.inf), s)
    owner = {int(p): int(p) for p in np.unique(parent[at])}

    def root(p: int) -> int:
        while owner[p] != p:
            p = owner[p]
        return p

    for (a, b), s in sorted(saddle.items(), key=lambda e: (-e[1], e[0])):
        a, b = sorted((root(int(a)), root(int(b))), key=lambda p: (flat[p], -p))
        if a != b and flat[a] - s < max(3.0, PART * flat[b]):
            owner[a] = b
    names = {p: k + 1 for k, p in enumerate(sorted({root(p) for p in owner}))}
    out = np.zeros(flat.size, np.int64)
    if at.size:
        peaks, inverse = np.unique(parent[at], return_inverse=True)
        out[at] = np.array([names[root(int(p))] for p in peaks])[inverse]
    return out.reshape(h + 2, size)[1:-1, 1:-1]


def sources(residual: np.ndarray, noise: np.ndarray, valid: np.ndarray, sigma: float = SIGMA) -> tuple[list[dict], np.ndarray]:
    """Moments of each source of at least LEAST_PIXELS pixels, and the source numbers of all pixels."""
    snr = _filtered(residual, noise, valid)
    seg = segments(snr, sigma)
    y, x = np.nonzero(seg)
    k = seg[y, x]
    n = int(k.max()) + 1 if k.size else 1
    add = lambda v: np.bincount(k, v, n)
    # Shapes come from the filtered values, which are positive on a source; flux and peak from the pixels themselves.
    weight, flux = snr[y, x] * noise[y, x], np.where(valid, residual, 0)[y, x]
    total = np.where(add(weight) > 0, add(weight), 1)
    cx, cy = add(weight * x) / total, add(weight * y) / total
    xx, yy, xy = add(weight * (x - cx[k]) ** 2) / total, add(weight * (y - cy[k]) ** 2) / total, add(weight * (x - cx[k]) * (y - cy[k])) / total
    peak = np.full(n, -np.inf)
    np.maximum.at(peak, k, flux)
    pixels, support, sums = np.bincount(k, minlength=n), np.bincount(k[flux > sigma * noise[y, x]], minlength=n), add(flux)
    rows = [{"x": float(cx[i]), "y": float(cy[i]), "flux": float(sums[i]), "peak": float(peak[i]), "xx": float(xx[i]), "yy": float(yy[i]), "xy": float(xy[i]), "pixels": int(pixels[i]), "support": int(support[i])} for i in range(1, n) if pixels[i] >= LEAST_PIXELS]
    return rows, seg


def _cells(values: np.ndarray, valid: np.ndarray, measure) -> list[list[float | None]]:
    h, w = values.shape
    ys, xs = np.linspace(0, h, GRID + 1, dtype=int), np.linspace(0, w, GRID + 1, dtype=int)
    cell = lambda j, i: values[ys[j] : ys[j + 1], xs[i] : xs[i + 1]][valid[ys[j] : ys[j + 1], xs[i] : xs[i + 1]]]
    return [[float(measure(v)) if (v := cell(j, i)).size else None for i in range(GRID)] for j in range(GRID)]


def measure_image(image: np.ndarray, sigma: float = SIGMA) -> dict:
    """All measures of one preview, or its error."""
    valid = np.isfinite(image)
    share = float(valid.mean()) if image.size else 0.0
    if min(image.shape) < 16:
        return {"error": "PREVIEW_TOO_SMALL", "finite_fraction": share}
    if not valid.any():
        return {"error": "NO_FINITE_PIXELS", "finite_fraction": 0.0}
    if share < 0.10:
        return {"error": "TOO_FEW_FINITE_PIXELS", "finite_fraction": share}
    values = image[valid].astype(np.float64)
    med = float(np.median(values))
    low, high = (float(p) for p in np.percentile(values, (0.1, 99.9)))
    filled = np.where(valid, image, med).astype(np.float64)
    back, noise = background(filled, valid)
    residual = filled - back
    least = max(float(np.finfo(np.float32).eps) * max(1.0, abs(med)), 1e-12)
    floor = max(float(np.median(noise)), _middle(residual[valid])[1], least)
    noise = np.where(np.isfinite(noise) & (noise > least), noise, floor)
    found, seg = sources(residual, noise, valid, sigma)
    return {
        "error": None, "finite_fraction": share, "median": med, "mad": float(np.median(np.abs(values - med))), "p001": low, "p999": high,
        "background_grid": _cells(back, valid, np.median), "texture_grid": _cells(residual, valid & (seg == 0), lambda v: _middle(v)[1]), "sources": found,
    }


_SOURCE = pa.struct([*[(n, pa.float64()) for n in ("x", "y", "flux", "peak", "xx", "yy", "xy")], ("pixels", pa.int32()), ("support", pa.int32())])
_GRID = pa.list_(pa.list_(pa.float64()))
_FIELDS = [("error", pa.string()), *[(n, pa.float64()) for n in ("finite_fraction", "median", "mad", "p001", "p999")], ("background_grid", _GRID), ("texture_grid", _GRID), ("sources", pa.list_(_SOURCE))]
_DDL = "error string, finite_fraction double, median double, mad double, p001 double, p999 double, background_grid array<array<double>>, texture_grid array<array<double>>, sources array<struct<x: double, y: double, flux: double, peak: double, xx: double, yy: double, xy: double, pixels: int, support: int>>"


def measured(previews: DataFrame, frame: str = "frame", sigma: float = SIGMA) -> DataFrame:
    """(frame, height, width, error, finite_fraction, median, mad, p001, p999, background_grid, texture_grid, sources): one row a preview.

    A preview without data has the error NO_IMAGE; one bad frame stops nothing.
    """
    kind = previews.schema[frame].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.schema([batch.schema.field(frame), ("height", pa.int32()), ("width", pa.int32()), *_FIELDS])
            for r in batch.to_pylist():
                own = {"error": "NO_IMAGE"} if r["data"] is None else measure_image(np.frombuffer(r["data"], "<f4").reshape(r["height"], r["width"]), sigma)
                yield pa.RecordBatch.from_pylist([{frame: r[frame], "height": r["height"], "width": r["width"]} | own], names)

    return previews.select(frame, F.col("height").cast("int"), F.col("width").cast("int"), "data").mapInArrow(run, f"`{frame}` {kind}, height int, width int, {_DDL}")


def star_rows(frames: DataFrame, frame: str = "frame", support: int = LEAST_SUPPORT, most: int = MOST_STARS) -> DataFrame:
    """(frame, star, x, y, flux, peak, a, b, theta, fwhm, ellipticity, pixels, support): a frame's stars by falling flux, at most `most`.

    A source with fewer than `support` pixels above the threshold before filtering is no star; support 0
    gives the raw list.  A shape below a pixel's own width takes that width.
    """
    s = frames.select(frame, F.explode("sources").alias("s")).select(frame, "s.*").where((F.col("flux") > 0) & (F.col("support") >= support))
    thin = F.col("xx") * F.col("yy") - F.pow("xy", F.lit(2)) < 0.00694  # a twelfth of a pixel, squared
    s = s.withColumns({c: F.col(c) + F.when(thin, 1 / 12.0).otherwise(0.0) for c in ("xx", "yy")})
    mean, half = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow("xy", F.lit(2)))
    s = s.withColumns({"a": F.sqrt(mean + half), "b": F.sqrt(F.greatest(mean - half, F.lit(0.0))), "theta": F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2}).where("b > 0")
    s = s.withColumns({"fwhm": 2 * np.sqrt(2 * np.log(2)) * F.sqrt(F.col("a") * F.col("b")), "ellipticity": 1 - F.col("b") / F.col("a")})
    order = F.row_number().over(Window.partitionBy(frame).orderBy(F.col("flux").desc(), "y", "x"))
    s = s.withColumn("star", order).where(F.col("star") <= most)
    return s.select(frame, "star", "x", "y", "flux", "peak", "a", "b", "theta", "fwhm", "ellipticity", "pixels", "support")


def frame_rows(frames: DataFrame, stars: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, error, finite_fraction, median, mad, dynamic_range, detected, raw_detected, fwhm, ellipticity): a frame's row for the gates.

    Counts and medians are of all supported stars; a frame without any keeps its row with null shapes.
    """
    raw = F.size(F.filter("sources", lambda s: s["flux"] > 0))
    per = stars.groupBy(frame).agg(F.count("*").alias("detected"), F.percentile("fwhm", F.lit(0.5)).alias("fwhm"), F.percentile("ellipticity", F.lit(0.5)).alias("ellipticity"))
    heads = frames.select(frame, "error", "finite_fraction", "median", "mad", F.greatest(F.col("p999") - F.col("p001"), F.lit(0.0)).alias("dynamic_range"), F.when(F.col("sources").isNotNull(), raw).alias("raw_detected"))
    out = heads.join(per, frame, "left").withColumn("detected", F.when(F.col("error").isNull(), F.coalesce("detected", F.lit(0))))
    return out.select(frame, "error", "finite_fraction", "median", "mad", "dynamic_range", "detected", "raw_detected", "fwhm", "ellipticity")
