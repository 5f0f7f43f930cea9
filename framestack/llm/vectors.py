"""Product codes of vectors: integer k-means of each part, trained by tree aggregation over columnar blocks.

kept() leaves the rows whose vectors can be coded.  train() writes their integer components once as blocks,
part by part and dimension by dimension, and lets an RDD of those blocks run a treeAggregate a round: a task
adds up distances one dimension after another, takes each part's nearest entry, and adds parts into an int64
sum and count tensor, which merge through a reduction tree; only (parts, entries, dimensions) numbers reach the
driver.  encode() gives every row its code and error in one narrow pass.

A component x becomes the integer floor(4096 x); a block with a component beyond EXACT works with Python's
integers, so that no sum or square overflows, and an error beyond 64 bits is null.  Rows whose vector is null or holds
null or non-finite components are dropped.  The dimension is that of the first kept vector (by vec_id,
nulls last; ties by components); rows of another length, or all rows if it is no positive multiple of the
parts, stay with a null code and error and take no part in training.  Repeated rows count as often as they
come.  Fewer rows than entries give fewer entries, and an empty table gives empty codebooks and no rows.  Ties
between entries go to the lower index.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, with_totals

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components up to this size leave room for squares summed over 2^16 dimensions in 64 bits.
EXACT = 1 << 22
#: Rows of a block.
BLOCK_ROWS = 2000
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, entries, dimensions of a part) integers; empty where nothing could be learned."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector has only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) as int64, or as Python integers where it is large."""
    scaled = np.floor(values * float(SCALE))
    if not scaled.size or np.abs(scaled).max() <= EXACT:
        return scaled.astype(np.int64)
    return np.array([int(np.floor(v)) * SCALE if abs(v) > 2.0**960 else int(np.floor(v * SCALE)) for v in values.ravel()], object).reshape(values.shape)


def nearest(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; columns: (dimensions of a part, rows)."""
    if columns.dtype != entries.dtype:
        columns, entries = columns.astype(object), entries.astype(object)
    distance = np.zeros((len(entries), columns.shape[1]), columns.dtype)
    for column, at in zip(columns, entries.T):
        step = column[None, :] - at[:, None]
        distance += step * step
    index = distance.argmin(0)
    return index, distance[index, np.arange(columns.shape[1])]


def _numbers(a: np.ndarray) -> np.ndarray:
    """int64 again where all values are small enough for exact work."""
    return a.astype(np.int64) if a.dtype == object and (not a.size or abs(a).max() <= EXACT) else a


def _blocks(rows: DataFrame, dimension: int, parts: int) -> DataFrame:
    """(n, wide, data): columnar int64 blocks of shape (parts, dimensions of a part, n); wide ones as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([v for v in batch.column(0).to_pylist() if len(v) == dimension], float).reshape(-1, dimension)
            if not len(values):
                continue
            block = integers(values).T.reshape(parts, dimension // parts, len(values))
            wide = block.dtype == object
            data = ",".join(map(str, block.ravel().tolist())).encode() if wide else np.ascontiguousarray(block, "<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int64()), pa.array([wide]), pa.array([data], pa.binary())], ["n", "wide", "data"])

    return rows.select("vector").mapInArrow(run, "n long, wide boolean, data binary")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of kept rows: the first vectors by vec_id, moved to the floored means of their parts `rounds` times."""
    spark = rows.sparkSession
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    dimension = len(first[0][0]) if first else 0
    if not dimension or dimension % parts:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    if any(len(r[0]) != dimension for r in first):
        alike = rows.where(F.size("vector") == dimension)
        first = alike.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    width = dimension // parts
    start = integers(np.array([r[0] for r in first], float))
    books = np.stack([start[:, p * width : (p + 1) * width] for p in range(parts)])
    bounded_batches(spark, BLOCK_ROWS)
    blocks = stored(_blocks(rows, dimension, parts), "blocks").rdd.map(tuple)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def add(total, row):
            n, wide, data = row
            block = np.array([int(x) for x in data.decode().split(",")], object) if wide else np.frombuffer(data, "<i4").astype(np.int64)
            block = block.reshape(parts, width, n)
            at = shared.value
            sums, counts = total or (np.zeros(at.shape, np.int64), np.zeros(at.shape[:2], np.int64))
            if wide and sums.dtype != object:
                sums = sums.astype(object)
            for p in range(parts):
                index, _ = nearest(block[p], at[p])
                np.add.at(sums[p], index, block[p].T)
                np.add.at(counts[p], index, 1)
            return sums, counts

        def merge(a, b):
            return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

        total = blocks.treeAggregate(None, add, merge, depth=3)
        shared.unpersist()
        if total is None:
            break
        sums, counts = total
        used = counts[:, :, None] > 0
        books = _numbers(np.where(used, sums // np.maximum(counts, 1)[:, :, None], books))
    return Codebooks(books)


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of kept rows: two hex digits for each part, and the squared distances summed."""
    bounded_batches(rows.sparkSession, BLOCK_ROWS)
    books, dimension = codebooks.entries, codebooks.dimension
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            fits = [i for i, v in enumerate(vectors) if dimension and len(v) == dimension]
            codes, errors = [None] * len(vectors), [None] * len(vectors)
            if fits:
                block = integers(np.array([vectors[i] for i in fits], float)).T.reshape(parts, width, len(fits))
                found = [nearest(block[p], books[p]) for p in range(parts)]
                digits = np.stack([index for index, _ in found], 1).astype(np.uint8)
                for i, code, error in zip(fits, digits, sum(d.astype(object) for _, d in found)):
                    codes[i], errors[i] = code.tobytes().hex(), error if error <= LONGEST else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors of all rows of the same label (nulls together) summed; no label is gathered in one task."""
    return with_totals(coded, ["label"], F.coalesce(F.xxhash64("vec_id", "code"), F.lit(0)), {"label_error": "error"})
