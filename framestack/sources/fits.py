"""FITS images as DataFrames of headers and row tiles, and back.

Spark lists the files and deals them to tasks.  A task reads only the header blocks and rows that are
asked for where Arrow can seek in the storage (`SEEKABLE`); elsewhere whole files come through Spark's
binaryFile reader.  Tiles hold little-endian float32 samples in physical values (BSCALE, BZERO applied,
BLANK as NaN), row-major, `rows` rows of `width` samples from row `y0` on.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
#: What an Arrow batch of files or tiles holds, beside its first row.
BATCH_BYTES = 16 << 20
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
EXTENSIONS = ("fit", "fits", "fts")
GLOB = "*.{[fF][iI][tT],[fF][iI][tT][sS],[fF][tT][sS]}"
#: Storage in which tasks seek by Arrow's file systems.
SEEKABLE = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
#: Bytes of one unit's header.
MOST_HEADER = 1 << 24
# Cards that name a colour mosaic, and its patterns.
MOSAIC = ("BAYERPAT", "BAYERPATN", "CFAPAT", "CFAPATTERN", "PCL:CFASourcePattern")
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")
_VALUE = re.compile(r"^\s*(?:'((?:[^']|'')*)'|([^/]*?))\s*(?:/.*)?$")


def parse_header(data: bytes, start: int = 0) -> tuple[dict[str, str], int]:
    """Cards as text and the offset behind the header's last block."""
    cards: dict[str, str] = {}
    at = start
    while at + CARD <= len(data):
        card = data[at : at + CARD].decode("ascii", "replace")
        at += CARD
        name = card[:8].strip()
        if name == "END":
            return cards, start + -(-(at - start) // BLOCK) * BLOCK
        if card[8:10] == "= " and (m := _VALUE.match(card[10:])):
            text = m.group(1)
            cards.setdefault(name, (m.group(2) or "").strip() if text is None else text.replace("''", "'").rstrip())
    raise ValueError("header without END")


def _size(cards: dict[str, str]) -> tuple[list[int], int]:
    axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", 0)) + 1)]
    count = int(np.prod(axes)) if axes else 0
    return axes, (count * abs(int(cards["BITPIX"])) // 8 + int(cards.get("PCOUNT", 0))) * int(cards.get("GCOUNT", 1))


def _unit(f: BinaryIO, at: int) -> tuple[dict[str, str], int]:
    """Cards of the unit at an offset, read block by block, and the offset of its data."""
    f.seek(at)
    head = b""
    while len(head) < MOST_HEADER and (block := f.read(BLOCK)):
        head += block
        if any(block[i : i + 8].rstrip() == b"END" for i in range(0, len(block), CARD)):
            return parse_header(head)[0], at + len(head)
    raise ValueError("header without END")


def open_image(f: BinaryIO) -> tuple[dict[str, str], list[int], int]:
    """Header, axes and data offset of the first unit with two or more axes; the data of others are skipped unread."""
    at = 0
    while True:
        f.seek(at)
        if not f.read(1):
            raise ValueError("no image")
        cards, body = _unit(f, at)
        axes, size = _size(cards)
        if len(axes) >= 2 and size and cards.get("XTENSION", "IMAGE") == "IMAGE":
            return cards, axes, body
        at = body + -(-size // BLOCK) * BLOCK


def first_image(data: bytes) -> tuple[dict[str, str], list[int], int]:
    """open_image of a file's bytes."""
    return open_image(io.BytesIO(data))


def physical(raw: np.ndarray, cards: dict[str, str]) -> np.ndarray:
    """Stored samples as float32 in physical values."""
    out = raw.astype(np.float64)
    if raw.dtype.kind != "f" and "BLANK" in cards:
        out[raw == int(float(cards["BLANK"]))] = np.nan
    scale, zero = float(cards.get("BSCALE", 1)), float(cards.get("BZERO", 0))
    return (out * scale + zero).astype(np.float32)


def read_rows(f: BinaryIO, unit: tuple[dict[str, str], list[int], int], y0: int, y1: int) -> np.ndarray:
    """Physical float32 rows y0 to y1 of the first plane: one seek and one read."""
    cards, axes, body = unit
    kind = np.dtype(TYPES[int(cards["BITPIX"])])
    f.seek(body + y0 * axes[0] * kind.itemsize)
    size = axes[0] * (y1 - y0) * kind.itemsize
    data = f.read(size)
    if len(data) < size:
        raise ValueError("data end early")
    return physical(np.frombuffer(data, kind).reshape(-1, axes[0]), cards)


def decode_rows(data: bytes, y0: int = 0, y1: int | None = None) -> np.ndarray:
    """Physical float32 rows y0 to y1 of the first plane of a file's bytes."""
    f = io.BytesIO(data)
    unit = open_image(f)
    return read_rows(f, unit, y0, unit[1][1] if y1 is None else min(y1, unit[1][1]))


def block_means(read: Callable[[int, int], np.ndarray], height: int, width: int, block: int) -> np.ndarray:
    """Means of block x block samples, NaN left out and partial blocks at the edges kept; `read` gives rows y0 to y1."""
    starts, out = np.arange(0, width, block), []
    for y in range(0, height, block):
        band = read(y, min(y + block, height)).astype(np.float64)
        known = np.isfinite(band)
        n = np.add.reduceat(known.sum(0), starts)
        out.append(np.where(n > 0, np.add.reduceat(np.where(known, band, 0).sum(0), starts) / np.maximum(n, 1), np.nan))
    return np.array(out, np.float32)


def preview_block(width: int, height: int, most: int, cards: dict[str, str]) -> int:
    """Samples a preview pixel has on a side: the longer edge keeps within `most`; even for a colour mosaic."""
    block = max(1, -(-max(width, height) // most))
    mosaic = any(cards.get(k, "").strip().upper() in PATTERNS for k in MOSAIC)
    return block + block % 2 if mosaic else block


def _card(name: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float, np.number)):
        text = f"{value!r:>20}" if not isinstance(value, np.number) else f"{value.item()!r:>20}"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{name[:8]:<8}= {text}"[:CARD].ljust(CARD).encode("ascii", "replace")


def encode(image: np.ndarray, header: dict | None = None) -> bytes:
    """A float32 FITS file of a 2-D (or 3-D, plane first) array."""
    image = np.asarray(image, np.float32)
    cards = [_card("SIMPLE", True), _card("BITPIX", -32), _card("NAXIS", image.ndim)]
    cards += [_card(f"NAXIS{i + 1}", int(n)) for i, n in enumerate(reversed(image.shape))]
    cards += [_card(k, v) for k, v in (header or {}).items() if k not in ("SIMPLE", "BITPIX", "END") and not k.startswith("NAXIS")]
    head = b"".join([*cards, b"END".ljust(CARD)])
    body = image.astype(">f4").tobytes()
    return head + b" " * (-len(head) % BLOCK) + body + b"\0" * (-len(body) % BLOCK)


def domain_scale(bitpix: Column, low: Column, high: Column) -> Column:
    """The factor to a 0 to 1 domain: from stated end points, else from the stored type; 1 for floats."""
    stated = F.when(high > low, 1 / (high - low))
    stored = F.when(bitpix == 8, 1 / 255.0).when(bitpix == 16, 1 / 65535.0).when(bitpix == 32, 1 / 4294967295.0)
    return F.coalesce(stated, stored, F.lit(1.0))


# -- Spark -------------------------------------------------------------------------------------


def discover(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, size, modified) of the frame files below a path, housekeeping files left out; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.element_at(F.split(name, r"\."), -1).isin(*extensions)
    return files.where(wanted & ~F.startswith(name, F.lit(".")) & ~F.startswith(name, F.lit("~"))).distinct()


def seekable(path: str) -> bool:
    return urlsplit(path).scheme in SEEKABLE


def opened(path: str, content: bytes | None) -> BinaryIO:
    """A file to seek in: its bytes where Spark has read them, else the file itself."""
    if content is not None:
        return io.BytesIO(content)
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or SEEKABLE.get(scheme) == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
    system, name = fs.FileSystem.from_uri(f"{SEEKABLE[scheme]}:{rest}")
    return system.open_input_file(name)


def scan(spark: SparkSession, path: str, glob: str, work: Callable[[str, BinaryIO], Iterator[dict]], arrow: pa.Schema, ddl: str, failed: Callable[[str, str], dict] | None = None) -> DataFrame:
    """The rows that `work` makes of each file below a path, one at a time; of a broken file the `failed` row, or none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    whole = not seekable(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist() if whole else [None] * len(batch)):
                try:
                    with opened(name, data) as f:
                        for row in work(name, f):
                            yield pa.RecordBatch.from_pylist([row], arrow)
                except (ValueError, KeyError, AttributeError, TypeError, OSError) as e:
                    if failed:
                        yield pa.RecordBatch.from_pylist([failed(name, str(e) or type(e).__name__)], arrow)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return files.select("path", *(["content"] if whole else [])).mapInArrow(run, ddl)


def no_header(path: str, error: str) -> dict:
    return {"path": path, "width": None, "height": None, "bitpix": None, "header": None, "error": error}


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, bitpix, header map, error): one row a file, of its header blocks alone; a broken file has its error and nulls."""

    def work(name: str, f: BinaryIO) -> Iterator[dict]:
        cards, axes, _ = open_image(f)
        yield {"path": name, "width": axes[0], "height": axes[1], "bitpix": int(cards["BITPIX"]), "header": list(cards.items()), "error": None}

    return scan(spark, path, GLOB, work, _HEADERS, HEADER, no_header)


HEADER = "path string, width int, height int, bitpix int, header map<string,string>, error string"
_HEADERS = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bitpix", pa.int32()), ("header", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
TILE = "path string, y0 int, rows int, width int, data binary"
_TILE = pa.schema([("path", pa.string()), ("y0", pa.int32()), ("rows", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])


def tile(path: str, y0: int, band: np.ndarray) -> dict:
    return {"path": path, "y0": y0, "rows": len(band), "width": band.shape[1], "data": band.astype("<f4").tobytes()}


def tiles(spark: SparkSession, path: str, rows: int = 64, between: tuple[int, int] | None = None) -> DataFrame:
    """(path, y0, rows, width, data): row bands of every readable image, of all rows or those in `between`, which alone are read."""

    def work(name: str, f: BinaryIO) -> Iterator[dict]:
        unit = open_image(f)
        low, high = between or (0, unit[1][1])
        high = min(high, unit[1][1])
        for y in range(max(0, low), high, rows):
            yield tile(name, y, read_rows(f, unit, y, min(y + rows, high)))

    return scan(spark, path, GLOB, work, _TILE, TILE)


def row_gather(spark: SparkSession, path: str, ys: list[int]) -> DataFrame:
    """(path, y0, rows = 1, width, data) of the listed rows of every readable image, each read on its own; rows outside an image are left out."""

    def work(name: str, f: BinaryIO) -> Iterator[dict]:
        unit = open_image(f)
        for y in sorted({y for y in ys if 0 <= y < unit[1][1]}):
            yield tile(name, y, read_rows(f, unit, y, y + 1))

    return scan(spark, path, GLOB, work, _TILE, TILE)


PREVIEW = "path string, height int, width int, block int, data binary, error string"
_PREVIEW = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("error", pa.string())])


def preview(path: str, image: np.ndarray, block: int) -> dict:
    return {"path": path, "height": len(image), "width": image.shape[1], "block": block, "data": image.astype("<f4").tobytes(), "error": None}


def no_preview(path: str, error: str) -> dict:
    return {"path": path, "height": None, "width": None, "block": None, "data": None, "error": error}


def previews(spark: SparkSession, path: str, most: int = 1600) -> DataFrame:
    """(path, height, width, block, data, error): block means with at most `most` pixels on the longer edge, read band by band."""

    def work(name: str, f: BinaryIO) -> Iterator[dict]:
        unit = open_image(f)
        cards, (width, height) = unit[0], unit[1][:2]
        block = preview_block(width, height, most, cards)
        yield preview(name, block_means(lambda a, b: read_rows(f, unit, a, b), height, width, block), block)

    return scan(spark, path, GLOB, work, _PREVIEW, PREVIEW, no_preview)


def samples(tile_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, value): tiles as one row a sample; NaN becomes null."""
    names = [*keys, "y", "x", "value"]
    kinds = {f.name: f.dataType.simpleString() for f in tile_rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["data"], "<f4")
                at = np.arange(len(values))
                own = [pa.array([row[k]] * len(values), batch.schema.field(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array((row["y0"] + at // row["width"]).astype(np.int32)), pa.array((at % row["width"]).astype(np.int32)), pa.array(values, mask=np.isnan(values))], names)

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y int, x int, value float"])
    return tile_rows.select(*keys, "y0", "rows", "width", "data").mapInArrow(run, schema)


def files(tile_rows: DataFrame, keys: list[str], header: dict | None = None) -> DataFrame:
    """(keys, content binary, sha256): each key's tiles put together to one file; a key is one image's size."""
    kinds = {f.name: f.dataType.simpleString() for f in tile_rows.schema}

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["y0"])
        image = np.concatenate([np.frombuffer(r["data"], "<f4").reshape(-1, r["width"]) for r in rows])
        out = {k: [rows[0][k]] for k in keys} | {"content": [encode(image, header)]}
        return pa.table({k: pa.array(v, table.schema.field(k).type if k in keys else pa.binary()) for k, v in out.items()})

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "content binary"])
    out = tile_rows.select(*keys, "y0", "width", "data").groupBy(*keys).applyInArrow(join, schema)
    return out.withColumn("sha256", F.sha2("content", 256))
