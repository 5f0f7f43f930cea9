"""Structured Streaming forms of the time-based operators.

Each takes a streaming DataFrame of (key, ts timestamp, ...) and gives one; state is bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def night_statistics(stream: DataFrame, keys: list[str], ts: str, value: str, late: str = "1 day") -> DataFrame:
    """(night, keys, n, low, high, mean) of observing nights, which run from noon to noon; final once the watermark passes."""
    rows = stream.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, "1 day", "1 day", "12 hours").alias("w"), *keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return out.select(F.to_date("w.start").alias("night"), *keys, "n", "low", "high", "mean")


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(keys, session_start, session_end, n) by session windows."""
    out = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def sliding_counts(stream: DataFrame, keys: list[str], ts: str, length: str = "6 hours", slide: str = "3 hours", late: str = "1 day") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")


def first_copies(stream: DataFrame, digest: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose digest was not seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([digest])


def gap_blocks(stream: DataFrame, key: str, ts: str, gap_seconds: float = 7200.0, late: str = "1 day") -> DataFrame:
    """(key, block, start, end, n): blocks of one key, closed by a gap longer than gap_seconds once the watermark has passed it.

    Unlike a session window, a gap of exactly gap_seconds does not part blocks.  State holds a
    key's open blocks as (start, end, n), so rows may come in any order within the watermark.
    """
    kind = stream.schema[key].dataType.simpleString()

    def merge(blocks: list[tuple[float, float, int]]) -> list[tuple[float, float, int]]:
        out: list[tuple[float, float, int]] = []
        for start, end, n in sorted(blocks):
            if out and start - out[-1][1] <= gap_seconds:
                a, b, m = out[-1]
                out[-1] = (a, max(b, end), m + n)
            else:
                out.append((start, end, n))
        return out

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed_n, blocks = 0, []
        if state.exists:
            closed_n, starts, ends, counts = state.get
            blocks = list(zip(starts, ends, counts))
        for pdf in batches:
            blocks += [(t, t, 1) for t in pdf["seconds"]]
        blocks = merge(blocks)
        mark = state.getCurrentWatermarkMs() / 1000
        done = [b for b in blocks if mark > b[1] + gap_seconds]
        left = blocks[len(done) :]
        if done:
            yield pd.DataFrame({key: [k[0]] * len(done), "block": range(closed_n, closed_n + len(done)), "start": [b[0] for b in done], "end": [b[1] for b in done], "n": [b[2] for b in done]})
        if left or not state.hasTimedOut:
            state.update((closed_n + len(done), [b[0] for b in left], [b[1] for b in left], [b[2] for b in left]))
        if left:
            state.setTimeoutTimestamp(max(int((left[0][1] + gap_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.hasTimedOut:
            state.remove()

    rows = stream.withWatermark(ts, late).select(key, ts, (F.unix_micros(ts) / 1e6).alias("seconds"))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, block long, start double, end double, n long", "closed long, starts array<double>, ends array<double>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def baselines_by_night(stream: DataFrame, batch_writer, ts: str = "ts"):
    """A foreachBatch stream that hands batch_writer(nights, batch_id) the nights each batch touches, to recompute them whole: late rows change a night's baselines."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch_writer(batch.select(F.to_date(F.col(ts) - F.expr("INTERVAL 12 HOURS")).alias("night")).distinct(), batch_id)

    return stream.writeStream.foreachBatch(each)
