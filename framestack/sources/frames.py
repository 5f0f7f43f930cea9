"""Frames of any format below a path: each file goes to the reader of its kind, whatever the case of its ending."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from . import fits, xisf

GLOB = "*.{[fF][iI][tT],[fF][iI][tT][sS],[fF][tT][sS],[xX][iI][sS][fF]}"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, bitpix, header map, error) of every frame file, without its samples."""
    return fits.headers(spark, path).unionByName(xisf.headers(spark, path))


def tiles(spark: SparkSession, path: str, rows: int = 64) -> DataFrame:
    """(path, y0, rows, width, data): row bands of every readable frame."""
    return fits.tiles(spark, path, rows).unionByName(xisf.tiles(spark, path, rows))


def previews(spark: SparkSession, path: str, most: int = 1600) -> DataFrame:
    """(path, height, width, block, data, error): bounded block-mean previews, for operators.measure."""
    return fits.previews(spark, path, most).unionByName(xisf.previews(spark, path, most))


#: Bytes of a file's head whose digest is compared before whole files are read, and of one read.
HEAD, CHUNK = 65536, 1 << 20


def _digests(files: DataFrame, name: str, read: Callable[[BinaryIO], str]) -> DataFrame:
    """(path, length, name) of the files that can be read; each is opened where Spark deals its path to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
                try:
                    with fits.opened(path, None) as f:
                        rows.append({"path": path, "length": length, name: read(f)})
                except OSError:
                    continue  # a file that can't be read is nobody's copy
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("length", pa.int64()), (name, pa.string())]))

    return files.select("path", "length").repartition("path").mapInArrow(run, f"path string, length bigint, {name} string")


def _head(f: BinaryIO) -> str:
    return hashlib.md5(f.read(HEAD)).hexdigest()


def _whole(f: BinaryIO) -> str:
    digest = hashlib.sha256()
    while part := f.read(CHUNK):
        digest.update(part)
    return digest.hexdigest()


def twins(spark: SparkSession, path: str) -> DataFrame:
    """(path, first, digest) of byte-identical frame files, with the smallest path of the equal ones.

    Lengths come from the listing; only files that share one have their heads read, and only those that share that too
    are read whole, in parts.  No content is a column, so none is shuffled.  Spark's listing leaves empty files out.  Storage in which tasks can't seek goes through
    Spark's reader and joins.staged_duplicates().
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(path)
    if not fits.seekable(path):
        return joins.staged_duplicates(files.select("path", "content"), "path", "content")

    def shared(rows: DataFrame, on: list[str]) -> DataFrame:
        return rows.join(rows.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").select(*on), on, "left_semi")

    heads = joins.cut(_digests(shared(files.select("path", "length"), ["length"]), "head", _head))
    whole = joins.cut(_digests(shared(heads, ["length", "head"]), "digest", _whole))
    first = whole.groupBy("digest").agg(F.min("path").alias("first"), F.count("*").alias("_n")).where("_n > 1").select("digest", "first")
    return whole.join(first, "digest").select("path", "first", "digest")
