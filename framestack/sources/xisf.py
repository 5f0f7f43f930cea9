"""XISF images as headers and tiles: a bounded XML header and attached blocks, plain or compressed, with byte shuffling."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import fits

MAGIC = b"XISF0100"
MOST_HEADER = 1 << 24
# Sample formats.
SAMPLES = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "UInt64": "<u8", "Float32": "<f4", "Float64": "<f8"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse(data: bytes) -> ElementTree.Element:
    """The header's root; entity declarations and oversized headers are refused."""
    if data[:8] != MAGIC:
        raise ValueError("no XISF file")
    size = int.from_bytes(data[8:12], "little")
    if size > MOST_HEADER or 16 + size > len(data):
        raise ValueError("header size")
    text = data[16 : 16 + size].rstrip(b"\0")
    if re.search(rb"<!(DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("declarations in the header")
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(str(e)) from e


def unshuffle(raw: bytes, item: int) -> bytes:
    whole = len(raw) // item * item
    return np.frombuffer(raw, np.uint8, whole).reshape(item, -1).T.tobytes() + raw[whole:]


def shuffle(raw: bytes, item: int) -> bytes:
    whole = len(raw) // item * item
    return np.frombuffer(raw, np.uint8, whole).reshape(-1, item).T.tobytes() + raw[whole:]


def expand(raw: bytes, compression: str | None) -> bytes:
    """The plain bytes of a block compressed as codec:size[:item]."""
    if not compression:
        return raw
    codec, size, *item = compression.split(":")
    base, _, shuffled = codec.partition("+")
    if base == "zlib":
        try:
            out = zlib.decompress(raw)
        except zlib.error as e:
            raise ValueError(str(e)) from e
    elif base in ("lz4", "lz4hc", "zstd"):
        out = pa.Codec("zstd" if base == "zstd" else "lz4_raw").decompress(raw, int(size)).to_pybytes()
    else:
        raise ValueError(f"codec {base}")
    if len(out) != int(size):
        raise ValueError("block size")
    return unshuffle(out, int(item[0])) if shuffled and item else out


def described(node: ElementTree.Element) -> tuple[dict[str, str], int, int, int]:
    """Keywords, width, height and channels that an image element states; its samples aren't read."""
    sizes = [int(x) for x in ((node.get("geometry") or "") + ":1").split(":")[:3]]
    fmt = node.get("sampleFormat")
    if fmt not in SAMPLES:
        raise ValueError(f"samples {fmt}")
    words = {n.get("name"): (n.get("value") or "").strip("'").strip() for n in node.iter() if _local(n.tag) == "FITSKeyword"}
    bounds = node.get("bounds")
    return words | {"sampleFormat": fmt} | ({"bounds": bounds} if bounds else {}), *sizes


def first_node(root: ElementTree.Element) -> ElementTree.Element:
    """The first image; thumbnails are elements of another name."""
    node = next((n for n in root.iter() if _local(n.tag) == "Image"), None)
    if node is None:
        raise ValueError("no image")
    return node


def open_node(f: BinaryIO) -> ElementTree.Element:
    """The first image's element, of the header alone."""
    head = f.read(16)
    size = int.from_bytes(head[8:12], "little")
    if head[:8] != MAGIC or size > MOST_HEADER:
        raise ValueError("no XISF file")
    return first_node(parse(head + f.read(size)))


def samples(f: BinaryIO, node: ElementTree.Element) -> np.ndarray:
    """Samples (channels, height, width) of an image: its attached block alone is read."""
    _, width, height, channels = described(node)
    kind, _, place = (node.get("location") or "").partition(":")
    if kind != "attachment":
        raise ValueError("only attached blocks")
    start, size = (int(x) for x in place.split(":"))
    f.seek(start)
    raw = expand(f.read(size), node.get("compression"))
    return np.frombuffer(raw, SAMPLES[node.get("sampleFormat")], width * height * channels).reshape(channels, height, width)


def rows_of(f: BinaryIO, node: ElementTree.Element) -> Callable[[int, int], np.ndarray]:
    """A reader of rows y0 to y1, as float64 means over the channels: of a plain block those rows alone are read."""
    _, width, height, channels = described(node)
    kind, _, place = (node.get("location") or "").partition(":")
    if node.get("compression") or kind != "attachment":
        whole = samples(f, node)
        return lambda y0, y1: _channel_mean(whole[:, y0:y1].astype(np.float64))
    start, form = int(place.split(":")[0]), np.dtype(SAMPLES[node.get("sampleFormat")])

    def read(y0: int, y1: int) -> np.ndarray:
        out = []
        for c in range(channels):
            f.seek(start + (c * height + y0) * width * form.itemsize)
            out.append(np.frombuffer(f.read((y1 - y0) * width * form.itemsize), form, (y1 - y0) * width).reshape(-1, width))
        return _channel_mean(np.array(out, np.float64))

    return read


def _channel_mean(values: np.ndarray) -> np.ndarray:
    known = np.isfinite(values)
    n = known.sum(0)
    return np.where(n > 0, np.where(known, values, 0).sum(0) / np.maximum(n, 1), np.nan)


def image(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Keywords and samples (channels, height, width) of the first image of a file's bytes."""
    f = io.BytesIO(data)
    node = open_node(f)
    return described(node)[0], samples(f, node)


def build(values: np.ndarray, keywords: dict[str, str] | None = None, compression: str | None = None) -> bytes:
    """An XISF file of (channels, height, width) samples; compression: zlib, lz4, zstd, each also with +sh."""
    values = np.atleast_3d(values) if values.ndim == 3 else values[None]
    fmt = next(k for k, v in SAMPLES.items() if np.dtype(v) == values.dtype.newbyteorder("<"))
    raw, item = values.astype(SAMPLES[fmt]).tobytes(), values.dtype.itemsize
    extra = ""
    if compression:
        base, _, sh = compression.partition("+")
        body = shuffle(raw, item) if sh else raw
        packed = zlib.compress(body) if base == "zlib" else pa.Codec("zstd" if base == "zstd" else "lz4_raw").compress(body).to_pybytes()
        extra = f' compression="{compression}:{len(raw)}{f":{item}" if sh else ""}"'
    else:
        packed = raw
    words = "".join(f'<FITSKeyword name="{k}" value="{v}"/>' for k, v in (keywords or {}).items())
    c, h, w = values.shape
    start = 4096
    xml = f'<?xml version="1.0"?><xisf version="1.0"><Image geometry="{w}:{h}:{c}" sampleFormat="{fmt}" location="attachment:{start}:{len(packed)}"{extra}>{words}</Image></xisf>'.encode()
    head = MAGIC + len(xml).to_bytes(4, "little") + bytes(4) + xml
    return head + bytes(start - len(head)) + packed


GLOB = "*.[xX][iI][sS][fF]"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, bitpix, header map, error) as for FITS, of the header alone; the bits are those of the sample format, negative for floats."""

    def work(name: str, f: BinaryIO) -> Iterator[dict]:
        words, width, height, _ = described(open_node(f))
        form = np.dtype(SAMPLES[words["sampleFormat"]])
        yield {"path": name, "width": width, "height": height, "bitpix": form.itemsize * 8 * (-1 if form.kind == "f" else 1), "header": list(words.items()), "error": None}

    return fits.scan(spark, path, GLOB, work, fits._HEADERS, fits.HEADER, fits.no_header)


def tiles(spark: SparkSession, path: str, rows: int = 64) -> DataFrame:
    """Row bands of the first channel, as for FITS."""

    def work(name: str, f: BinaryIO) -> Iterator[dict]:
        v = samples(f, open_node(f))
        for y in range(0, v.shape[1], rows):
            yield fits.tile(name, y, v[0, y : y + rows])

    return fits.scan(spark, path, GLOB, work, fits._TILE, fits.TILE)


def previews(spark: SparkSession, path: str, most: int = 1600) -> DataFrame:
    """Block means of the channels' mean, as for FITS; of plain blocks only bands are held."""

    def work(name: str, f: BinaryIO) -> Iterator[dict]:
        node = open_node(f)
        words, width, height, _ = described(node)
        block = fits.preview_block(width, height, most, words)
        yield fits.preview(name, fits.block_means(rows_of(f, node), height, width, block), block)

    return fits.scan(spark, path, GLOB, work, fits._PREVIEW, fits.PREVIEW, fits.no_preview)
