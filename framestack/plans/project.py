"""From a folder of frames to stacked masters: inventory, calibration groups and matches, masters, calibrated lights, stacks.

Every step is a DataFrame of frames (metadata) or of row tiles (samples).  stacks() takes frames as on one pixel grid;
registered_stacks() measures them, finds their similarities and brings them to a common one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks, grouping, joins, measure, registration, tiles, windows
from ..sources import fits
from ..sources import frames as formats


def _card(name: str) -> Column:
    v = F.element_at("header", name)
    return F.when(F.trim(v) != "", F.trim(v))


def assets(spark: SparkSession, path: str) -> DataFrame:
    """One row a distinct frame: path, role, filter, exposure, camera, gain, binning, night, size and error.

    The role comes from the header, else from the folder's or file's name.  Of byte-identical files
    the smallest path stays.
    """
    heads = formats.headers(spark, path)
    twins = formats.twins(spark, path).where("path <> first").select("path")
    when = F.to_timestamp(F.regexp_replace(_card("DATE-OBS"), "Z$", ""))
    return heads.join(twins, "path", "left_anti").select(
        "path",
        # A type that the header states but nobody knows is never overruled by the path; a frame that names none is a light.
        F.when(text.cleaned(_card("IMAGETYP")).isNotNull(), text.frame_role(_card("IMAGETYP"))).otherwise(F.coalesce(text.role_in_path(F.col("path")), F.when(F.col("error").isNull(), "LIGHT"))).alias("role"),
        text.filter_name(_card("FILTER")).alias("filter"),
        F.coalesce(_card("EXPTIME"), _card("EXPOSURE")).try_cast("double").alias("exposure"),
        _card("INSTRUME").alias("camera"),
        _card("GAIN").try_cast("double").alias("gain"),
        _card("XBINNING").try_cast("int").alias("binning"),
        F.coalesce(_card("OBJECT"), F.lit("UNKNOWN")).alias("target"),
        windows.night(when).alias("night"),
        "width",
        "height",
        "error",
    )


def issues(frames: DataFrame) -> DataFrame:
    """(path, code): what keeps frames from being used."""
    checks = {
        "UNREADABLE": F.col("error").isNotNull(),
        "ROLE_UNKNOWN": F.col("error").isNull() & F.col("role").isNull(),
        "EXPOSURE_MISSING": F.col("role").isin("DARK", "LIGHT") & F.col("exposure").isNull(),
        "FILTER_MISSING": F.col("role").isin("FLAT", "LIGHT") & F.col("filter").isNull(),
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return frames.select("path", F.explode(codes).alias("code"))


def calibration_groups(frames: DataFrame) -> DataFrame:
    """Calibration frames with `group`: bias by camera and binning, darks also by exposure, flats by filter and night."""
    role = F.col("role")
    group = grouping.group_id(role, F.col("camera"), F.col("gain"), F.col("binning"), F.col("width"), F.col("height"), F.when(role == "DARK", F.col("exposure")), F.when(role == "FLAT", F.col("filter")), F.when(role == "FLAT", F.col("night")))
    return frames.where(role.isin("BIAS", "DARK", "FLAT")).withColumn("group", group)


def matches(frames: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, role, bias, dark, flat, dark_candidates, flat_candidates): the best groups of each light and flat.

    Unknown settings forbid nothing.  A dark is nearest in exposure; a flat has the filter, and the
    same night before the nearest other.
    """
    g = groups.groupBy("group").agg(*[F.min(c).alias(f"g_{c}") for c in ("role", "camera", "gain", "binning", "width", "height", "exposure", "filter", "night")])
    same = joins.same_or_unknown
    fits_sensor = same(F.col("camera"), F.col("g_camera")) & same(F.col("gain"), F.col("g_gain")) & same(F.col("binning"), F.col("g_binning")) & (F.col("width") == F.col("g_width")) & (F.col("height") == F.col("g_height"))
    lights = frames.where(F.col("role").isin("LIGHT", "FLAT"))
    out = lights
    for role, ok, rank in (
        ("BIAS", F.lit(True), [F.lit(0)]),
        ("DARK", F.col("role") == "LIGHT", [F.round(F.abs(F.col("exposure") - F.col("g_exposure")), 6)]),
        ("FLAT", (F.col("role") == "LIGHT") & joins.same_and_known(F.col("filter"), F.col("g_filter")), [F.coalesce(F.abs(F.date_diff("night", "g_night")), F.lit(10**6))]),
    ):
        found = joins.best_match(lights, "path", g.where(F.col("g_role") == role), [], fits_sensor & ok, rank, [F.col("group")])
        out = out.join(found.select("path", F.col("group").alias(role.lower()), F.col("candidates").alias(f"{role.lower()}_candidates")), "path")
    return out


def _calibrated(rows: DataFrame, normalise: bool) -> DataFrame:
    """Tiles (path, y0, rows, width, data, bias_data, dark_data, flat_data, flat_level) calibrated in numpy, row by row."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                image = lambda n: None if r[n] is None else np.frombuffer(r[n], "<f4").astype(np.float64)
                flat = image("flat_data")
                v = tiles.calibrate(image("data"), image("bias_data"), image("dark_data"), None)
                if flat is not None:
                    gain = flat / r["flat_level"]
                    v = np.where(gain > 1e-3, v / np.where(gain > 1e-3, gain, 1), np.nan)
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "y0": pa.array([r["y0"]], pa.int32()), "rows": pa.array([r["rows"]], pa.int32()), "width": pa.array([r["width"]], pa.int32()), "data": pa.array([v.astype("<f4").tobytes()], pa.binary())})

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(fits.BATCH_BYTES))
    out = rows.mapInArrow(run, fits.TILE)
    return _levelled(out) if normalise else out


def _level(frame_tiles: DataFrame, key: str) -> DataFrame:
    """(key, level): the median of each image; one image is one task's work."""
    kind = frame_tiles.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        v = np.concatenate([np.frombuffer(d, "<f4") for d in table["data"].to_pylist()])
        return pa.table({key: table[key][:1], "level": pa.array([float(np.nanmedian(v))])})

    return frame_tiles.select(key, "data").groupBy(key).applyInArrow(run, f"`{key}` {kind}, level double")


def _levelled(frame_tiles: DataFrame) -> DataFrame:
    """Each frame divided by its own median."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["data"], "<f4") / np.float32(r["level"] or 1.0)
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "y0": pa.array([r["y0"]], pa.int32()), "rows": pa.array([r["rows"]], pa.int32()), "width": pa.array([r["width"]], pa.int32()), "data": pa.array([v.astype("<f4").tobytes()], pa.binary())})

    return frame_tiles.join(_level(frame_tiles, "path"), "path").select("path", "y0", "rows", "width", "data", "level").mapInArrow(run, fits.TILE)


def _with(rows: DataFrame, masters: DataFrame, role: str) -> DataFrame:
    m = masters.select(F.col("group").alias(role), "y0", F.col("data").alias(f"{role}_data"))
    return rows.join(m, [role, "y0"], "left")


def calibrated(spark: SparkSession, path: str, rows: int = 64) -> DataFrame:
    """(path, y0, rows, width, data, target, filter): row bands of the lights, with their masters of bias, dark and flat applied."""
    frames = joins.cut(assets(spark, path))
    usable = frames.join(issues(frames).select("path").distinct(), "path", "left_anti")
    groups = joins.cut(calibration_groups(usable))
    matched = joins.cut(matches(usable, groups))
    every = formats.tiles(spark, path, rows)
    member = every.join(groups.select("path", "group", "role"), "path")
    plain = joins.cut(tiles.stack_tiles(member.where("role in ('BIAS', 'DARK')"), ["group"], "path").select("group", "y0", "data"))
    none = F.lit(None).cast("binary")
    flats = every.join(matched.where("role = 'FLAT'").select("path", "bias"), "path")
    flats = _with(flats, plain, "bias").withColumns({"dark_data": none, "flat_data": none, "flat_level": F.lit(1.0)})
    level = _calibrated(flats, normalise=True).join(groups.where("role = 'FLAT'").select("path", "group"), "path")
    flat = joins.cut(tiles.stack_tiles(level, ["group"], "path").select("group", "y0", "data"))
    lights = every.join(matched.where("role = 'LIGHT'").select("path", "bias", "dark", "flat"), "path")
    lights = _with(_with(_with(lights, plain, "bias"), plain, "dark"), flat, "flat")
    lights = lights.join(_level(flat, "group").withColumnsRenamed({"group": "flat", "level": "flat_level"}), "flat", "left")
    return _calibrated(lights, normalise=False).join(usable.select("path", "target", "filter"), "path")


def stacks(spark: SparkSession, path: str, rows: int = 64) -> DataFrame:
    """(target, filter, y0, rows, width, data, accepted, rejected): the calibrated lights of each target and filter, reduced."""
    return tiles.stack_tiles(calibrated(spark, path, rows), ["target", "filter"], "path")


def masters(spark: SparkSession, path: str, rows: int = 64) -> DataFrame:
    """(target, filter, content, sha256): one FITS file a stack."""
    return fits.files(stacks(spark, path, rows), ["target", "filter"])


def measures(spark: SparkSession, path: str, most: int = 1600) -> DataFrame:
    """operators.measure.measured() of every frame below a path, keyed by `path`, with its preview's `block`; written once, as stars and frames both come of it."""
    seen = formats.previews(spark, path, most)
    done = measure.measured(seen.select("path", "height", "width", "data"), "path")
    return joins.cut(done)


def registrations(stars: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, reference, similarity to it, counts, rms, accepted, reasons): every member against its group's frame of most stars, ties to the smaller path.

    `stars` is measure.star_rows() by path, `members` holds (keys, path).  The reference registers with itself;
    a member without stars keeps its row.
    """
    count = members.join(stars.groupBy("path").agg(F.count("*").alias("_n")), "path", "left")
    best = count.groupBy(*keys).agg(F.min_by("path", F.struct((-F.coalesce("_n", F.lit(0))).alias("n"), "path")).alias("reference"))
    pairs = joins.cut(members.select(*keys, "path").distinct().join(best, keys))
    own = ["path", "reference"]
    s = stars.select("path", "star", "x", "y", "flux")
    source = pairs.select(*own).distinct().join(s, "path", "left")
    reference = pairs.select(*own).distinct().join(s.withColumnRenamed("path", "reference"), "reference")
    return pairs.join(registration.register(source, reference, own, "star", "x", "y", "flux"), own)


def full_size(found: DataFrame, scale: str, reference_scale: str) -> Column:
    """The matrix (9 doubles) from the reference's pixels to a frame's, of a similarity found on previews of `scale` pixels a side."""
    k, q = F.col(scale).cast("double"), F.col(reference_scale).cast("double")
    c, d = (k - 1) / 2, (q - 1) / 2  # where a preview's first pixel has its middle
    a, b = q * F.col("a") / k, q * F.col("b") / k
    tx, ty = q * F.col("tx") + d - a * c + b * c, q * F.col("ty") + d - b * c - a * c
    zero, one = F.lit(0.0), F.lit(1.0)
    return blocks.inverse(F.array(a, -b, tx, b, a, ty, zero, zero, one))


def frame_matrices(spark: SparkSession, path: str, members: DataFrame, keys: list[str], most: int = 1600) -> DataFrame:
    """(keys, path, reference, height, width, out_height, out_width, m, accepted, reasons) of members (keys, path): measured, registered, at full size.

    The reference has the identity.  A frame that isn't accepted keeps its reasons; its matrix is null.
    """
    seen = measures(spark, path, most)
    found = registrations(measure.star_rows(seen, "path"), members, keys)
    sizes = formats.headers(spark, path).select("path", "height", "width").join(seen.select("path", F.col("height").alias("_h"), F.col("width").alias("_w")), "path")
    # A preview's block is the least that keeps within `most`, or the next even one: its size tells which.
    least = F.greatest(F.ceil(F.greatest("height", "width") / most), F.lit(1))
    fits_least = (F.ceil(F.col("height") / least) == F.col("_h")) & (F.ceil(F.col("width") / least) == F.col("_w"))
    sizes = joins.cut(sizes.select("path", "height", "width", F.when(fits_least, least).otherwise(least + 1).alias("scale")))
    there = sizes.select(F.col("path").alias("reference"), F.col("height").alias("out_height"), F.col("width").alias("out_width"), F.col("scale").alias("reference_scale"))
    met = found.join(sizes, "path", "left").join(there, "reference", "left")
    identity = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    own = F.col("path") == F.col("reference")
    m = F.when(own, identity).when(F.col("accepted"), full_size(met, "scale", "reference_scale"))
    return met.select(*keys, "path", "reference", "height", "width", "out_height", "out_width", m.alias("m"), (own | F.col("accepted")).alias("accepted"), F.when(~own, F.col("reasons")).alias("reasons"))


def registered_stacks(spark: SparkSession, path: str, side: int = 128, most: int = 1600) -> DataFrame:
    """(target, filter, x0, y0, rows, width, data, accepted, rejected): stacks of lights that lie on different grids, in square blocks.

    All filters of a target share the grid of its frame with most stars.  Calibrated lights go through one Lanczos-3
    interpolation; frames that don't register are left out.  Samples beyond a frame or over its bad pixels don't count.
    """
    lights = joins.cut(calibrated(spark, path, side))
    members = lights.select("target", "filter", "path").distinct()
    matrices = joins.cut(frame_matrices(spark, path, members.select("target", "path"), ["target"], most).where("accepted and m is not null"))
    windows_ = blocks.matrix_windows(matrices, ["path"], side)
    warped = blocks.warp(blocks.from_bands(lights, ["path"], side), windows_, ["path"], side, "<f4")
    square = warped.join(members, "path").select("target", "filter", "path", (F.col("bx") * side).alias("x0"), (F.col("by") * side).alias("y0"), F.lit(side).alias("rows"), F.lit(side).alias("width"), "data")
    return tiles.stack_tiles(square, ["target", "filter", "x0"], "path")
