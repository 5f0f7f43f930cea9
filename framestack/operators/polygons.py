"""Convex polygons (arrays of points x, y): areas, intersections, overlapping pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import cut, held, least_reached

#: Polygons of a block, candidates looked at at a time (of all pairs, of spanning ones) and pairs measured at a time.  A cell of more polygons than a block is met block by block.
BLOCK, CANDIDATES, SPANNED, CUT = 4096, 1 << 18, 1 << 14, 1 << 11
#: A corner is nearly on a line within this share of the longest side.
NEAR = 1e-6


def _rim(depth: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Twice the area swept by a polygon's sides as far as they lie in the other: depth (sides of the other, corners, pairs), turn (corners, pairs)."""
    fall = depth - np.roll(depth, -1, 1)
    t = depth / fall
    # A side that goes out ends there, one that comes in begins there; one along the line is in (+inf) or out (-inf).
    leaves = fall >= 0
    first, last = np.where(leaves, 0.0, t).max(0), np.where(leaves, t, 1.0).min(0)
    return (np.maximum(np.minimum(last, 1.0) - np.maximum(first, 0.0), 0.0) * turn).sum(0)


def shared_areas(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Areas that counterclockwise convex polygons share, row by row; rows of fewer corners than others repeat their last one.

    The rim of what is shared is each polygon's rim within the other.  Where a corner lies nearly on the line of a side, rims
    could count twice or not at all: those pairs are cut.
    """
    x0, y0 = bx[:, :1], by[:, :1]
    (ux, uy), (vx, vy) = ((np.ascontiguousarray((x - x0).T), np.ascontiguousarray((y - y0).T)) for x, y in ((ax, ay), (bx, by)))
    sides = lambda x, y: (np.roll(x, -1, 0) - x, np.roll(y, -1, 0) - y)
    depth = lambda x, y, px, py, ex, ey: ex[:, None] * (y - py[:, None]) - ey[:, None] * (x - px[:, None])
    a, b = sides(ux, uy), sides(vx, vy)
    da, db = depth(ux, uy, vx, vy, *b), depth(vx, vy, ux, uy, *a)
    with np.errstate(divide="ignore", invalid="ignore"):
        area = (_rim(da, ux * a[1] - uy * a[0]) + _rim(db, vx * b[1] - vy * b[0])) / 2
    long = np.maximum(*(np.maximum(ex * ex, ey * ey).max(0) for ex, ey in (a, b)))
    at = np.flatnonzero(np.minimum(np.abs(da).min((0, 1)), np.abs(db).min((0, 1))) <= NEAR * long)
    if len(at):
        area[at] = _cut_areas(ax[at], ay[at], bx[at], by[at])
    return area


def _cut_areas(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """shared_areas() by cutting a along the line of each of b's sides, safe for sides on one line."""
    area, row, x, y = np.zeros(len(ax)), np.arange(len(ax)), ax.copy(), ay.copy()
    for k in range(bx.shape[1]):
        px, py = bx[row, k, None], by[row, k, None]
        qx, qy = bx[row, (k + 1) % bx.shape[1], None], by[row, (k + 1) % bx.shape[1], None]
        depth = (qx - px) * (y - py) - (qy - py) * (x - px)
        inside = depth >= 0
        some, whole = inside.any(1), inside.all(1)
        if not some.all():
            row, x, y, depth, inside, whole = row[some], x[some], y[some], depth[some], inside[some], whole[some]
        at = np.flatnonzero(~whole)
        if not len(at):
            continue
        i, d, ox, oy = inside[at], depth[at], x[at], y[at]
        crossed = i != np.roll(i, 1, 1)
        # A corner's crossing comes before the corner itself.
        place = np.cumsum(crossed + i.astype(int), 1)
        width = max(int(place[:, -1].max()), x.shape[1])
        nx, ny = np.zeros((2, len(at), width))
        r, c = np.nonzero(i)
        nx[r, place[r, c] - 1], ny[r, place[r, c] - 1] = ox[r, c], oy[r, c]
        r, c = np.nonzero(crossed)
        before, slot = c - 1, place[r, c] - 1 - i[r, c]
        t = d[r, before] / (d[r, before] - d[r, c])
        nx[r, slot] = ox[r, before] + t * (ox[r, c] - ox[r, before])
        ny[r, slot] = oy[r, before] + t * (oy[r, c] - oy[r, before])
        r, c = np.nonzero(np.arange(width) >= place[:, -1:])
        nx[r, c], ny[r, c] = nx[r, place[r, -1] - 1], ny[r, place[r, -1] - 1]
        if width > x.shape[1]:
            rest = width - x.shape[1]
            x, y = (np.concatenate([v, np.repeat(v[:, -1:], rest, 1)], 1) for v in (x, y))
        x[at], y[at] = nx, ny
    area[row] = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) / 2
    return area


def _corners(column: pa.ListArray) -> np.ndarray:
    """Lists of numbers as rows of equal length: short ones repeat their last number."""
    first, n = column.offsets.to_numpy()[:-1], column.value_lengths().to_numpy()
    return column.values.to_numpy()[first[:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)]


def _met(table: pa.Table, keys: list[str], cell: float, least: float, spanning: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a group: of polygons of one block, or of each of two blocks with those of the other."""
    head = table.slice(0, 1).to_pylist()[0]
    ids, x, y = table["id"].combine_chunks(), _corners(table["_x"].combine_chunks()), _corners(table["_y"].combine_chunks())
    turn = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)
    x, y = (np.where(turn[:, None] < 0, v[:, ::-1], v) for v in (x, y))
    order = np.argsort(x.min(1), kind="stable")
    order = order[turn[order] != 0]
    x, y, block = x[order], y[order], table["_block"].to_numpy()[order]
    rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1][order]
    x0, x1, y0, y1 = x.min(1), x.max(1), y.min(1), y.max(1)
    in_x, in_y = np.floor(x0 / cell) == head["_cx"], np.floor(y0 / cell) == head["_cy"]
    # All pairs: rows by rising x0 with those that start later and within them.  Spanning ones: scattered rows with any not yet connected.
    n = len(order)
    label, every, rows = np.arange(n), np.arange(n), np.random.default_rng(n).permutation(n) if spanning else np.arange(n)
    step = max(1, (SPANNED if spanning else CANDIDATES) // max(1, n))
    for at in range(0, n, step):
        r = rows[at : at + step, None]
        c = every if spanning else every[at + 1 : np.searchsorted(x0, x1[r].max(), "left")]
        near = (x0[c] < x1[r]) & (y0[c] < y1[r]) & (y0[r] < y1[c])
        if spanning:
            near &= (x0[r] < x1[c]) & (label[r] != label[c])
        else:
            # A pair counts in the first cell that both reach.
            near &= in_x[c] & (in_y[r] | in_y[c]) & (r < c) & (rank[r] != rank[c])
            if head["_i"] != head["_j"]:
                near &= block[r] != block[c]
        i, j = np.nonzero(near)
        i, j = r[i, 0], c[j]
        i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
        area = np.concatenate([np.zeros(0), *[shared_areas(x[a], y[a], x[b], y[b]) for a, b in ((i[k : k + CUT], j[k : k + CUT]) for k in range(0, len(i), CUT))]])
        kept = area > least
        i, j, area = i[kept], j[kept], area[kept]
        if spanning:
            label = least_reached(label, i, j)
            if not label.any():
                break
        elif len(i):
            own = [pa.repeat(head_value, len(i)) for head_value in (table[k][0] for k in keys)]
            yield pa.RecordBatch.from_arrays([*own, ids.take(pa.array(order[i])), ids.take(pa.array(order[j])), pa.array(area)], [*keys, "a", "b", "area"])
    if spanning and len(i := np.flatnonzero(rank != rank[label])):
        j = label[i]
        i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
        own = [pa.repeat(head_value, len(i)) for head_value in (table[k][0] for k in keys)]
        yield pa.RecordBatch.from_arrays([*own, ids.take(pa.array(order[i])), ids.take(pa.array(order[j]))], [*keys, "a", "b"])


def overlapping(polygons: DataFrame, keys: list[str], key: str, points: str, cell: float, least: float = 0.0, spanning: bool = False) -> DataFrame:
    """(keys, a, b, area) of convex polygons that share more than `least` area, a < b; those that only touch share none.

    Polygons meet in the grid cells of their boxes, and a pair counts in the first cell both reach.  A cell of about a
    polygon's size is right.  Corners may run either way; polygons without area or with unknown corners meet none.
    `spanning` gives only (keys, a, b) of links that connect what the pairs connect: what is connected already is not cut again.
    """
    rows = polygons.select(*keys, F.col(key).alias("id"), *[F.col(points)[c].cast("array<double>").alias(f"_{c}") for c in "xy"])
    rows = rows.where(F.col("id").isNotNull() & F.forall("_x", lambda v: F.abs(v) < 1e15) & F.forall("_y", lambda v: F.abs(v) < 1e15))
    cells = lambda v: F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell))
    dealt = rows.withColumn("_cx", F.explode(cells("_x"))).withColumn("_cy", F.explode(cells("_y")))
    at = [*keys, "_cx", "_cy"]
    crowded = cut(dealt.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK))
    if crowded.head(1):
        same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in at]
        dealt = dealt.alias("d").join(held(crowded).alias("c"), same, "left").select("d.*", F.ceil(F.coalesce("_n", F.lit(1)) / BLOCK).alias("_n"))
        dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("id"), "_n")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        dealt = dealt.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_n", "_other")
    else:
        dealt = dealt.withColumns({c: F.lit(0).cast("long") for c in ("_block", "_i", "_j")})
    kinds = ", ".join(f"`{k}` {dealt.schema[k].dataType.simpleString()}" for k in keys)
    kind = dealt.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _met(pa.Table.from_batches(batches), keys, cell, least, spanning)

    return dealt.groupBy(*at, "_i", "_j").applyInArrow(run, f"{kinds}{', ' if keys else ''}a {kind}, b {kind}{'' if spanning else ', area double'}")
