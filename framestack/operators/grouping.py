"""Group identities, tolerance splits and expansions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import cut


def group_id(*parts: Column, length: int = 12) -> Column:
    """The first hex digits of the SHA-256 of the parts as canonical JSON; nulls count."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("UNKNOWN")) for p in parts])), 256), 1, length)


def tolerance_split(df: DataFrame, keys: list[str], value: str, tolerance: float, out: str = "split") -> DataFrame:
    """df with the number of each row's run of values: a sorted value opens a new run when it is more than the tolerance above the run's running mean.

    The running mean depends on what came before, so the distinct values of a key are walked in one
    task; equal values are counted first, which bounds a key to its distinct values.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(value)
        run, total, count, got = -1, 0.0, 0, []
        for v, n in zip(part[value], part["_n"]):
            if count and abs(v - total / count) <= tolerance:
                total, count = total + v * n, count + n
            else:
                run, total, count = run + 1, v * n, n
            got.append(run)
        return part.assign(**{out: got}).drop(columns="_n")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema if f.name != "_n") + f", `{out}` int"
    return df.join(values.groupBy(*keys).applyInPandas(walk, schema), [*keys, value], "left")


def split_by_heads(df: DataFrame, keys: list[str], frame: str, order: list[Column], accepts: Callable[[DataFrame], DataFrame], out: str = "field") -> DataFrame:
    """(keys, frame, head, out): the frames of each group in clusters, numbered from 1 in the order of their heads.

    As a walk in the given order would do it: a frame joins the first cluster whose head accepts it, or opens one.  A round
    makes the first free frame of every group a head and asks `accepts` which pairs (keys, frame, head) hold together, so there are
    as many rounds as the group of most clusters has, and no pair is asked twice.  Ties of the order go by the frame.
    A head is in its own cluster whatever accepts() says.
    """
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(frame).alias("frame"))
    left = cut(df.select(*keys, frame, by.alias("_by")).dropDuplicates([*keys, frame]))
    done, turn = None, 0
    while left.head(1):
        turn += 1
        heads = left.groupBy(*keys).agg(F.min("_by").alias("_first"))
        a, b = left.alias("a"), heads.alias("b")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
        pairs = cut(a.join(b, on).select("a.*", F.col("b._first.frame").alias("head")))
        own = pairs.where(F.col(frame) == F.col("head"))
        others = accepts(pairs.where(F.col(frame) != F.col("head")).select(*keys, frame, "head"))
        taken = cut(own.select(*keys, frame, "head").unionByName(others.select(*keys, frame, "head")).withColumn(out, F.lit(turn)))
        done = taken if done is None else done.unionByName(taken)
        gone = taken.alias("b")
        same = F.col(f"a.`{frame}`") == F.col(f"b.`{frame}`")
        for k in keys:
            same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
        left = cut(left.alias("a").join(gone, same, "left_anti"))
    return done if done is not None else left.select(*keys, frame, F.col(frame).alias("head"), F.lit(0).alias(out))


def expand_colors(df: DataFrame, color: str, is_mosaic: Column) -> DataFrame:
    """Rows of mosaic sensors once for each of R, G and B, others once."""
    own = F.array(F.col(color))
    return df.withColumn(color, F.explode(F.when(is_mosaic, F.array(F.lit("R"), F.lit("G"), F.lit("B"))).otherwise(own)))


def spread_warnings(df: DataFrame, keys: list[str], value: str, setting: str, tolerance: float) -> DataFrame:
    """(keys, spread, settings): groups whose values spread beyond the tolerance or whose settings differ."""
    rows = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"), F.count_distinct(setting).alias("settings"))
    return rows.where((F.col("spread") > tolerance) | (F.col("settings") > 1))


