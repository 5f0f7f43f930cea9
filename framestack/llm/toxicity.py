"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word has the sum of two hashed embeddings; filters of several widths run over the whole text, the
largest activation of each is kept, and a logistic layer makes the raw logit.  Training takes a
bounded sample of labelled texts; part of it calibrates a threshold for each language, and the
score is the logistic of the raw logit moved so that the threshold of the text's language falls on
CUT.  The language is read off the text's common words, never off a column.  Null and empty texts
have no words and get the score of an empty text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sampled_ids

BUCKETS, DIM = 1 << 17, 8
WIDTHS, FILTERS = (1, 2, 3), 8
#: The training sample: at most about so many texts of each label, none longer than LONGEST characters.
POSITIVE, NEGATIVE, LONGEST = 1200, 1800, 100_000
EPOCHS, BATCH, RATE = 5, 64, 0.03
#: The score at which a text counts as toxic.
CUT = 0.7
COMMON_WORDS = 60

_SECOND = 0x9E3779B1
#: ASCII characters other than letters and digits become blanks.
_BLANKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """crc32 of each word in lower case."""
    words = text.lower().encode().translate(_BLANKS).split() if text else []
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def rows_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two embedding rows of each word; row 0 is the padding between texts."""
    other = (hashes.astype(np.uint64) * np.uint64(_SECOND) >> np.uint64(12)).astype(np.uint32)
    return hashes % np.uint32(BUCKETS - 1) + 1, other % np.uint32(BUCKETS - 1) + 1


@dataclass
class Cnn:
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width * DIM, FILTERS)
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    languages: list[str] = field(default_factory=list)
    common: dict[int, int] = field(default_factory=dict)  # hash of a common word -> its language
    threshold: dict[str, float] = field(default_factory=dict)  # raw logits

    def pooled(self, texts: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """(texts, filters) largest activations, their word positions if asked for, and the two rows of each position."""
        gap = max(WIDTHS)
        size = np.array([len(t) for t in texts], np.int64)
        start = gap + np.cumsum(size + gap) - (size + gap)
        total = int((size + gap).sum()) + gap
        first, second = np.zeros(total, np.uint32), np.zeros(total, np.uint32)
        if size.sum():
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            first[at], second[at] = rows_of(np.concatenate(texts))
        x = np.take(self.embedding, first, axis=0)
        x += np.take(self.embedding, second, axis=0)
        best, where = [], []
        for width, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = total - width + 1
            y = w[:DIM].T @ x[:n].T
            for k in range(1, width):
                y += w[k * DIM : (k + 1) * DIM].T @ x[k : n + k].T
            lo, hi = start - width + 1, np.minimum(start + np.maximum(size, 1), n)
            best.append(np.maximum.reduceat(y, np.stack([lo, hi - 1], 1).ravel(), axis=1)[:, ::2].T)
            last = y[:, hi - 1].T
            np.maximum(best[-1], last, out=best[-1])
            best[-1] += b
            if places:
                where.append(np.array([u + y[:, u:v].argmax(1) for u, v in zip(lo.tolist(), hi.tolist(), strict=True)]))
        return np.concatenate(best, 1), np.concatenate(where, 1) if places else None, first, second

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(texts)[0], 0) @ self.weight + self.offset if texts else np.empty(0)

    def language(self, hashes: np.ndarray) -> str:
        """The language with most of its common words in the text; the first one where none occurs."""
        if not self.languages:
            return ""
        keys, owners = self._common_arrays()
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        hit = owners[at[keys[at] == hashes]]
        return self.languages[int(np.bincount(hit, minlength=len(self.languages)).argmax())]

    def _common_arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_common"):
            keys = np.array(sorted(self.common), np.uint32)
            self._common = keys, np.array([self.common[k] for k in keys.tolist()], np.int64)
        return self._common

    def scores(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Score and threshold of each text."""
        raw = self.logits(texts)
        cut = np.array([self.threshold.get(self.language(t), 0.0) for t in texts])
        return 1 / (1 + np.exp(-np.clip(raw - cut + np.log(CUT / (1 - CUT)), -500, 500))), cut


def _step(value: np.ndarray, grad: np.ndarray, memory: np.ndarray, rate: float) -> None:
    memory += grad * grad
    value -= rate * grad / (np.sqrt(memory) + 1e-8)


def _odds(texts: list[np.ndarray], label: np.ndarray) -> dict[int, float]:
    """Log odds of the hashes that occur in at least three of the texts."""
    seen = [Counter(), Counter()]
    for t, y in zip(texts, label.tolist(), strict=True):
        seen[y].update(np.unique(t).tolist())
    n0, n1 = max(1, int((label == 0).sum())), max(1, int((label == 1).sum()))
    return {h: float(np.log((k + 0.5) / (n1 + 1)) - np.log((seen[0][h] + 0.5) / (n0 + 1))) for h, k in seen[1].items() if k + seen[0][h] >= 3}


def train(texts: list[np.ndarray], label: np.ndarray, langs: list[str | None], epochs: int = EPOCHS, seed: int = 7) -> Cnn:
    """From word hashes, labels and languages; every fifth text of a label is kept for the thresholds."""
    rng = np.random.default_rng(seed)
    label = np.asarray(label, np.int64)
    held = np.zeros(len(texts), bool)
    for y in (0, 1):
        held[np.flatnonzero(label == y)[::5]] = True
    fit = np.flatnonzero(~held)
    model = Cnn(
        rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
    )
    model.embedding[0] = 0
    # The first component starts from the log odds of the words in the training texts.
    odds = _odds([texts[i] for i in fit], label[fit])
    if odds:
        keys = np.fromiter(odds, np.uint32)
        for rows in rows_of(keys):
            model.embedding[rows, 0] += np.clip(np.fromiter(odds.values(), float), -3, 6) / 4
        for w in model.filters:
            w[0, : FILTERS // 2] = np.abs(w[0, : FILTERS // 2]) + 1
        model.weight.reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 2] = 0.3
    memory = [np.zeros_like(v) for v in (model.embedding, *model.filters, *model.bias, model.weight)]
    offset_memory = 0.0
    share = max(1e-3, float(label[fit].mean())) if len(fit) else 0.5
    for _ in range(epochs if len(fit) and 0 < share < 1 else 0):
        for chosen in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            best, where, first, second = model.pooled([texts[i] for i in chosen], places=True)
            active = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-(active @ model.weight + model.offset)))
            g = (p - label[chosen]) * np.where(label[chosen] == 1, 0.5 / share, 0.5 / (1 - share)) / len(chosen)
            back = (g[:, None] * model.weight) * (best > 0)
            g_weight, g_offset = active.T @ g, float(g.sum())
            touched, amount = [], []
            for k, width in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                gb, place = back[:, part], where[:, part]
                g_filter = np.zeros_like(model.filters[k])
                for j in range(width):
                    a, b = first[place + j], second[place + j]
                    x = model.embedding[a] + model.embedding[b]
                    rows = slice(j * DIM, (j + 1) * DIM)
                    g_filter[rows] = np.einsum("nf,nfd->df", gb, x)
                    g_x = gb[:, :, None] * model.filters[k][rows].T[None]
                    touched += [a.ravel(), b.ravel()]
                    amount += [g_x.reshape(-1, DIM)] * 2
                _step(model.filters[k], g_filter, memory[1 + k], RATE)
                _step(model.bias[k], gb.sum(0), memory[1 + len(WIDTHS) + k], RATE)
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            g_rows = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g_rows, inverse, np.concatenate(amount))
            g_rows[rows == 0] = 0
            memory[0][rows] += g_rows * g_rows
            model.embedding[rows] -= RATE * g_rows / (np.sqrt(memory[0][rows]) + 1e-8)
            _step(model.weight, g_weight, memory[-1], RATE)
            offset_memory += g_offset * g_offset
            model.offset -= RATE * g_offset / (np.sqrt(offset_memory) + 1e-8)
    _languages(model, texts, langs)
    _calibrate(model, [texts[i] for i in np.flatnonzero(held)], label[held])
    return model


def _languages(model: Cnn, texts: list[np.ndarray], langs: list[str | None]) -> None:
    """The words that are common in one language and rarer in the others."""
    seen: dict[str, Counter] = {}
    size: Counter = Counter()
    for t, lang in zip(texts, langs, strict=True):
        if lang is not None:
            seen.setdefault(lang, Counter()).update(t.tolist())
            size[lang] += len(t)
    model.languages = [name for name, _ in Counter(x for x in langs if x is not None).most_common()]
    for i, name in enumerate(model.languages):
        for h, k in seen[name].most_common(COMMON_WORDS):
            rate = {o: seen[o][h] / max(1, size[o]) for o in model.languages}
            if rate[name] >= 2 * max([0, *(v for o, v in rate.items() if o != name)]):
                model.common[h] = i


def _calibrate(model: Cnn, texts: list[np.ndarray], label: np.ndarray) -> None:
    """For each language the raw logit that parts the held texts with least balanced error, mid-gap; few texts lean on all."""

    def cut(raw: np.ndarray, y: np.ndarray) -> float:
        if not len(y) or y.min() == y.max():
            return 0.0
        order = np.argsort(raw)
        raw, y = raw[order], y[order]
        missed = np.concatenate(([0], np.cumsum(y))) / y.sum()
        wrong = (np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))) / (1 - y).sum()
        error = missed + 4 * wrong  # clean texts are the many: a wrong rejection costs more
        best = np.flatnonzero(error <= error.min() + 1e-12)
        i = int(best[len(best) // 2])
        low, high = raw[max(0, i - 1)], raw[min(i, len(raw) - 1)]
        return float((low + high) / 2)

    raw = model.logits(texts)
    overall = cut(raw, label)
    names = np.array([model.language(t) for t in texts])
    for name in model.languages:
        mine = names == name
        n = min(int((label[mine] == 1).sum()), int((label[mine] == 0).sum()))
        model.threshold[name] = (n * cut(raw[mine], label[mine]) + 20 * overall) / (n + 20)


# -- Spark -------------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[np.ndarray], np.ndarray, list[str | None]]:
    """The bounded training sample: word hashes, labels and languages, in key order."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    parts = [sampled_ids(known.where(f"y = {y}"), "k", counts.get(y, 0), n) for y, n in ((1, POSITIVE), (0, NEGATIVE))]
    ids = parts[0].union(parts[1]).limit(2 * (POSITIVE + NEGATIVE))  # twice the expected rows: never met in practice
    chosen = F.broadcast(ids)
    rows = docs.where(F.length(text) <= LONGEST).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).join(chosen, "k").collect()
    rows.sort(key=lambda r: (r["k"], r["y"], r["t"]))
    return [word_hashes(r["t"]) for r in rows], np.array([r["y"] for r in rows], np.int64), [r["l"] for r in rows]


def classify(df: DataFrame, model: Cnn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double, threshold double) for every row; threshold is the raw logit of its language's cut."""
    bounded_batches(df.sparkSession, megabytes=4)
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, cut = shared.value.scores([word_hashes(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(cut, pa.float64())], [key, "score", "threshold"])

    rows = df.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, score double, threshold double")


def without_toxic(df: DataFrame, model: Cnn, text: str = "text", cut: float = CUT) -> DataFrame:
    """df without the rows that score at least `cut`; narrow, so no text is shuffled.  Columns stay as they are."""
    bounded_batches(df.sparkSession, megabytes=4)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = shared.value.scores([word_hashes(t) for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(score < cut))

    return df.mapInArrow(run, df.schema)
