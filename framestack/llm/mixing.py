"""Mixing sources to target weights, in DataFrame functions only.

Source shares of tokens are raised to an exponent between 0 (all sources equal) and 1 (as they are)
and normalised.  The exponent is bisected: the smallest one under which no source is repeated more
than `max_epochs` times, or the one whose weights have `entropy` bits.  The budget defaults to the
tokens at which the least repeated source is used exactly once, so no document is lost.  A source's
documents are dealt into blocks by hash; whole passes over all blocks repeat them, and a last, partial
pass takes blocks in permuted order, and documents in permuted order in its last block, until the
source's budget is spent.  Sources, not documents, meet in single rows; no source is gathered in a task.

A null source is a source of its own; null and empty texts have no tokens and are used in every whole pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MAX_EPOCHS = 2.0
#: Blocks of a source: of BLOCK_TOKENS tokens, at most MOST_BLOCKS.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 18, 1 << 16
#: Bisection: PASSES aggregates, each over GRID exponents, narrow the interval by GRID - 1.
PASSES, GRID = 5, 33


def tokens(text: Column) -> Column:
    """Blank-separated words."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, F.size(F.split(F.trim(text), r"\s+"))).otherwise(F.lit(0)).cast("long")


def source_tokens(sized: DataFrame) -> DataFrame:
    """(source, tokens) of rows (key, source, tokens)."""
    return sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))


def _curve(sources: DataFrame, low: float, high: float) -> list:
    """For each exponent of a grid: entropy of the weights in bits, and the largest repetition if the least is one."""
    grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
    each = sources.where("tokens > 0").select("tokens", F.explode(F.array(*map(F.lit, grid))).alias("exponent")).withColumn("mass", F.pow(F.col("tokens").cast("double"), "exponent"))
    each = each.withColumn("ratio", F.col("mass") / F.col("tokens"))
    return (
        each.groupBy("exponent")
        .agg(
            (F.log2(F.sum("mass")) - F.sum(F.col("mass") * F.log2("mass")) / F.sum("mass")).alias("entropy"),
            (F.max("ratio") / F.min("ratio")).alias("epochs"),
        )
        .orderBy("exponent")
        .collect()
    )


def exponent(sources: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None) -> float:
    """The exponent from 0 to 1 that meets the target.

    Entropy and repetition both fall as the exponent rises.  With `entropy`, the largest exponent
    that keeps at least so many bits (0 if none does); otherwise the smallest with at most
    `max_epochs` repetitions.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        rows = _curve(sources, low, high)
        if not rows:
            return 1.0
        if entropy is not None:
            good = [i for i, r in enumerate(rows) if r["entropy"] >= entropy - 1e-12]
            at = good[-1] if good else 0
            low, high = rows[at]["exponent"], rows[min(at + 1, len(rows) - 1)]["exponent"]
        else:
            good = [i for i, r in enumerate(rows) if r["epochs"] <= max_epochs + 1e-12]
            at = good[0] if good else len(rows) - 1
            low, high = rows[max(at - 1, 0)]["exponent"], rows[at]["exponent"]
        if high <= low:
            break
    return low if entropy is not None else high


def weights(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, target): target tokens of each source, which sum to the budget."""
    mass = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(F.lit(0.0))
    massed = sources.withColumn("mass", mass)
    total = massed.agg(F.sum("mass").alias("all"), F.max(F.col("tokens") / F.nullif("mass", F.lit(0.0))).alias("most")).first()  # one row
    every = float(total["all"] or 0.0)
    spend = float(budget) if budget is not None else every * float(total["most"] or 0.0)
    weight = F.col("mass") / every if every > 0 else F.lit(0.0)
    return massed.select("source", "tokens", weight.alias("weight"), (weight * spend).alias("target"))


def _lot(seed: int, *of: str) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def plan(
    df: DataFrame,
    max_epochs: float | None = MAX_EPOCHS,
    entropy: float | None = None,
    budget: float | None = None,
    seed: int = 11,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (key, source, tokens) of df, its block plan, and the keys that the last pass takes from blocks it splits.

    The block plan has a row for each block of each source: weight, whole passes, position in the
    last pass, whether that takes the whole block, and whether it splits it.
    """
    sized = stored(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), tokens(F.col(text)).alias("tokens")), "sized")
    per_source = stored(source_tokens(sized), "sources")
    aims = weights(per_source, exponent(per_source, max_epochs, entropy), budget)
    used = F.col("target") / F.col("tokens") + 1e-9
    aims = aims.select(
        *_named("source"),
        "weight",
        F.when(F.col("tokens") > 0, F.floor(used)).otherwise(1).cast("long").alias("passes"),
        F.least(F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)), F.lit(MOST_BLOCKS)).alias("blocks"),
        F.when(F.col("tokens") > 0, F.col("target") - F.floor(used) * F.col("tokens")).otherwise(0.0).alias("rest"),
    )
    named = sized.select("key", "tokens", *_named("source"))
    dealt = named.join(aims, ["s", "none"]).withColumn("block", F.pmod(_lot(seed, "key"), F.col("blocks")))
    blocks = dealt.groupBy("s", "none", "weight", "passes", "blocks", "rest", "block").agg(F.sum("tokens").alias("block_tokens"))
    order = Window.partitionBy("s", "none").orderBy(_lot(seed + 1, "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("position", F.count("*").over(order)).withColumn("left", F.col("rest") - F.sum("block_tokens").over(order) + F.col("block_tokens"))
    whole = (F.col("left") >= F.col("block_tokens") - 1e-6) & (F.col("block_tokens") > 0)
    blocks = blocks.select(
        "s", "none", "weight", "passes", "blocks", "block", "position", "left", whole.alias("whole"), ((F.col("left") > 0) & (F.col("left") < F.col("block_tokens") - 1e-6)).alias("split")
    )
    blocks = stored(blocks, "blocks")
    edge = dealt.select("s", "none", "block", "key", "tokens").join(blocks.where("split").select("s", "none", "block", "left"), ["s", "none", "block"])
    edge = edge.groupBy("s", "none", "block", "left", "key").agg(F.sum("tokens").alias("tokens"))
    inside = Window.partitionBy("s", "none", "block").orderBy(_lot(seed + 2, "key"), "key").rowsBetween(Window.unboundedPreceding, 0)
    taken = edge.withColumn("sum", F.sum("tokens").over(inside)).where("sum <= left and tokens > 0").select("s", "none", "key")
    return sized, blocks, taken


def _named(source: str) -> list[Column]:
    """A source as two columns without nulls."""
    return [F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.col(source).isNull().alias("none")]


def apply(df: DataFrame, blocks: DataFrame, taken: DataFrame, seed: int = 11, key: str = "doc_id", source: str = "source") -> DataFrame:
    """df with weight, block, position, last_pass and copies (whole passes and the last one), which replace columns of these names.

    The plan's tables hold blocks and one block's documents a source, so that df itself is not shuffled where they are small.
    """
    own = [c for c in df.columns if c not in ("weight", "block", "position", "last_pass", "copies")]
    counts = blocks.select("s", "none", "blocks").distinct()
    rows = df.select(F.struct(*own).alias("row"), *_named(source), F.col(key).alias("key"))
    rows = rows.join(counts, ["s", "none"]).withColumn("block", F.pmod(_lot(seed, "key"), F.col("blocks"))).drop("blocks")
    rows = rows.join(blocks.drop("blocks", "left"), ["s", "none", "block"])
    t = taken.select(F.col("s").alias("ts"), F.col("none").alias("tn"), F.col("key").alias("tk"), F.lit(True).alias("edge"))
    rows = rows.join(t, rows["key"].eqNullSafe(t["tk"]) & (rows["s"] == t["ts"]) & (rows["none"] == t["tn"]) & rows["split"], "left")
    last = F.col("whole") | F.coalesce("edge", F.lit(False))
    return rows.select("row.*", "weight", "block", "position", last.alias("last_pass"), (F.col("passes") + last.cast("long")).alias("copies"))


def mix(df: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: float | None = None, seed: int = 11, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, tokens, weight, block, position, last_pass, copies): how often each document is used."""
    sized, blocks, taken = plan(df, max_epochs, entropy, budget, seed, key, source, text)
    return apply(sized, blocks, taken, seed, "key", "source").withColumnRenamed("key", key)


def repeated(df: DataFrame, max_epochs: float | None = MAX_EPOCHS, seed: int = 11, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """df with each row as often as the mixture uses it."""
    _, blocks, taken = plan(df, max_epochs, None, None, seed, key, source, text)
    used = apply(df, blocks, taken, seed, key, source)
    return used.where("copies > 0").select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth_copy")).select(*df.columns)
