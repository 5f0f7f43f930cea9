"""Quality classifier: regularised quadratic discriminant over document statistics.

features() computes transformed statistics of whole texts in one narrow pass; fit() sums class
moments over all labelled rows in Spark (no sample) and keeps the Cholesky factor of each class's
shrunken covariance; score() is the logistic of the difference of the Mahalanobis log densities.
Null and empty texts have the statistics of an empty text.  A class without labelled rows gives
score 0.5 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

NAMES = ("words", "word_length", "marks", "digits", "upper", "wide", "distinct_words", "distinct_lines", "line_words", "ended", "longest", "marked_words")
#: Share of the pooled spherical target in the class covariances; log densities are divided by TEMPER.
SHRINK, TEMPER = 0.1, 2.0

_LOWER, _UPPER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((97, 122), (65, 90), (48, 57)))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    share = lambda chars: (n - len(raw.translate(None, chars))) / max(1, n)
    heads = [x.rstrip(_MARKS) for x in words]
    marked = sum(len(x) - len(h) > 1 for x, h in zip(words, heads, strict=True))
    return [
        np.log1p(len(words)),
        np.log1p(n / w),
        np.sqrt(share(_MARKS)),
        np.sqrt(share(_DIGITS)),
        np.sqrt(share(_UPPER)),
        np.sqrt(share(_HIGH)),
        len(set(heads)) / w,
        len(set(lines)) / k,
        np.log1p(w / k),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / k,
        np.log1p(max(map(len, words), default=0)),
        np.sqrt(marked / w),
    ]


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, one double for each of NAMES)."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(got[:, i])) for i in range(len(NAMES)))], [key, *NAMES])

    rows = df.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in NAMES))


@dataclass
class Discriminant:
    mean: list[np.ndarray]
    inverse: list[np.ndarray]  # of the Cholesky factors
    constant: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.mean) < 2:
            return np.full(len(x), 0.5)
        density = [c - 0.5 * np.square((x - m) @ i.T).sum(1) for m, i, c in zip(self.mean, self.inverse, self.constant, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPER, -500, 500)))


def fit(labelled: DataFrame, label: str = "label", shrink: float = SHRINK) -> Discriminant:
    """From rows (label 0 or 1, one column for each of NAMES); rows with other labels are not used."""
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)]
    products = [F.sum(F.col(a) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, a in enumerate(NAMES) for j in range(i + 1)]
    rows = {int(r[label]): r for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums, *products).collect()}
    d = len(NAMES)
    mean, cov, count = [], [], []
    for c in (0, 1):
        if c not in rows or rows[c]["n"] < 2:
            return Discriminant([], [], [])
        n, r = rows[c]["n"], rows[c]
        m = np.array([r[f"s{i}"] for i in range(d)]) / n
        s = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / n - np.outer(m, m)
        mean.append(m)
        cov.append(s)
        count.append(n)
    pooled = sum(n * s for n, s in zip(count, cov, strict=True)) / sum(count)
    target = np.diag(np.diag(pooled) + 1e-3)
    inverse, constant = [], []
    for n, s in zip(count, cov, strict=True):
        share = min(1.0, shrink + d / n)  # few rows lean on the target
        factor = np.linalg.cholesky((1 - share) * s + share * target)
        inverse.append(np.linalg.inv(factor))
        constant.append(float(np.log(n / sum(count)) - np.log(np.diag(factor)).sum()))
    return Discriminant(mean, inverse, constant)


def score(feature_rows: DataFrame, model: Discriminant, key: str = "doc_id") -> DataFrame:
    """(key, score) for rows of features()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(1 + i).to_numpy() for i in range(len(NAMES))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], [key, "score"])

    rows = feature_rows.select(key, *NAMES)
    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, score double")


