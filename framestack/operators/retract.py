"""Stacks from which frames can be taken out again, and the loop that integrates, judges and removes.

build() stores samples by frame block and, for each cell, the sums of its clipped mean with a certificate: the
number of samples (its budget) that may go, whichever they are, without any other sample being clipped.
remove() subtracts a frame's samples where the certificate holds and stacks only the other touched cells anew,
from the stored samples; cells without a sample of the frames are not touched at all.  Results equal those of a
stack built without the frames, up to the rounding of sums.

The certificate of a cell of n samples and budget k: the median of what is left lies between the order
statistics k places around the middle, and the half of it that lies nearest to any such median spans at least the
narrowest window of half of n - k samples.  If the farthest sample then lies within the clip of that spread, none
can be rejected.  Cells with a rejected sample have no budget.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import cut, shared_path
from .stack import ABSOLUTE_FLOOR, CLIP, MIN_SAMPLES, numeric_floor, with_decisions
from .stats import MADN, clean

#: Largest share of a cell's samples that a certificate covers; half, a quarter of it and one sample are tried too.
BUDGET = 0.2


@dataclass(frozen=True)
class Stack:
    """keys of a cell; samples (keys, frame, block, v, w); cells with sums, budgets and, where samples are clipped, the bound (med, reach); the frames taken out so far."""

    keys: list[str]
    samples: DataFrame
    cells: DataFrame
    removed: DataFrame

    def result(self) -> DataFrame:
        """(keys, n, mean, n_accepted, n_rejected) of the cells that still have samples."""
        mean = F.when(F.col("sw") > 0, F.col("swv") / F.col("sw"))
        return self.cells.where("n > 0").select(*self.keys, "n", mean.alias("mean"), "n_accepted", (F.col("n") - F.col("n_accepted")).alias("n_rejected"))


def _certificate(n: Column, xs: Column, share: float) -> Column:
    """The samples that may leave sorted samples xs of which none is clipped; 0 if that is not certain for any."""
    k = F.greatest(F.lit(1), F.floor(n * share)).cast("int")
    at = lambda i: F.get(xs, F.greatest(F.lit(0), F.least(i, n - 1)).cast("int"))
    low, high = at(F.floor((n - 1) / 2) - k), at(F.ceil((n - 1) / 2) + k)
    reach = F.greatest(at(n - 1) - low, high - at(F.lit(0)))
    # Of n - k samples at least half lie within the new MAD of the new median.
    half = F.greatest(F.floor((n - k + 1) / 2), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), (n - half).cast("int"))
    width = F.array_min(F.transform(starts, lambda i: F.get(xs, i + half - 1) - F.get(xs, i))) / 2
    floor = F.greatest(F.lit(ABSOLUTE_FLOOR), numeric_floor(F.lit(0.0)))
    safe = reach <= CLIP * F.greatest(MADN * width, floor)
    return F.when(n < MIN_SAMPLES, n).when(safe, k).otherwise(0).cast("long")


def _stacked(samples: DataFrame, keys: list[str], share: float) -> DataFrame:
    rows = with_decisions(samples, keys, "v").where("v is not null")
    ok = F.col("accepted")
    cells = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(ok, F.col("w"))), F.lit(0.0)).alias("sw"),
        F.coalesce(F.sum(F.when(ok, F.col("w") * F.col("v"))), F.lit(0.0)).alias("swv"),
        F.count_if(ok).alias("n_accepted"),
        F.max("med").alias("med"),
        (CLIP * F.max("sigma")).alias("reach"),
        F.array_sort(F.collect_list("v")).alias("xs"),
    )
    clipped = F.col("n_accepted") < F.col("n")
    cells = cells.withColumns({"med": F.when(clipped, F.col("med")), "reach": F.when(clipped, F.col("reach"))})
    # the largest of a few budgets that holds
    sure = F.greatest(*[_certificate(F.col("n"), F.col("xs"), share / part) for part in (1, 2, 4, 1 << 20)])
    budget = F.when(F.col("n_accepted") == F.col("n"), sure).otherwise(0).cast("long")
    return cells.withColumn("budget", budget).drop("xs")


def build(df: DataFrame, keys: list[str], frame: str, value: str, weight: str | None = None, block: Column | None = None, share: float = BUDGET) -> Stack:
    """The stack of df's samples; block (by default a hash of the frame in 64) is the folder that holds a frame's samples.

    A sample without a finite value, or without a frame, counts nowhere.  A cell is a group of tens to thousands of
    samples; for few large groups use stack.clip_mean_large.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    where = block if block is not None else F.pmod(F.xxhash64(frame), F.lit(64)).cast("int")
    rows = df.select(*keys, F.col(frame).alias("frame"), where.alias("block"), clean(value).alias("v"), w.alias("w")).where("v is not null and frame is not null")
    path = shared_path(df.sparkSession)
    rows.write.partitionBy("block").parquet(path)
    samples = df.sparkSession.read.schema(rows.schema).parquet(path)
    none = samples.select("frame", "block").where("false")
    return Stack(list(keys), samples, cut(_stacked(samples, list(keys), share)), none)


def remove(stack: Stack, frames: DataFrame, share: float = BUDGET) -> Stack:
    """stack without the given frames (a column `frame`); frames that it lacks, or lost before, change nothing."""
    keys = stack.keys
    known = stack.samples.join(frames.select("frame").distinct(), "frame", "left_semi").select("frame", "block").distinct()
    gone = cut(known.join(stack.removed.select("frame"), "frame", "left_anti"))
    # the blocks of the frames prune the samples' folders at run time
    lost = stack.samples.join(gone, ["frame", "block"], "left_semi").groupBy(*keys).agg(F.count("*").alias("k"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("dw"), F.coalesce(F.sum(F.col("w") * F.col("v")), F.lit(0.0)).alias("dwv"))
    touched = cut(_null_safe(stack.cells, lost, keys, ["k", "dw", "dwv"]))
    same = touched.where("k is null")
    eased = touched.where("k <= budget or k = n")
    left = lambda c, d: (F.col(c) - F.col(d)).alias(c)
    eased = eased.select(*keys, left("n", "k"), F.when(F.col("k") == F.col("n"), 0.0).otherwise(F.col("sw") - F.col("dw")).alias("sw"), F.when(F.col("k") == F.col("n"), 0.0).otherwise(F.col("swv") - F.col("dwv")).alias("swv"), F.when(F.col("k") == F.col("n"), 0).otherwise(F.col("n_accepted") - F.col("k")).alias("n_accepted"), "med", "reach", F.greatest(F.col("budget") - F.col("k"), F.lit(0)).alias("budget"))
    hard = touched.where("k > budget and k < n").select(*keys, F.lit(True).alias("hard"))
    removed = cut(stack.removed.unionByName(gone))
    rest = _null_safe(stack.samples, hard, keys, ["hard"], "inner").drop("hard").join(removed.select("frame"), "frame", "left_anti")
    names = [*keys, "n", "sw", "swv", "n_accepted", "med", "reach", "budget"]
    cells = cut(same.select(*names).unionByName(eased.select(*names)).unionByName(_stacked(rest, keys, share).select(*names)))
    return replace(stack, cells=cells, removed=removed)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], more: list[str], how: str = "left") -> DataFrame:
    """left joined with the columns `more` of right on keys whose nulls are equal."""
    a, b = left.alias("a"), right.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return a.join(b, on, how).select("a.*", *[F.col(f"b.`{m}`") for m in more])


def harm(stack: Stack) -> DataFrame:
    """(frame, samples, scatter, share, gain): what the variance of the stack would lose without each frame.

    scatter is the mean square of a frame's accepted samples about the mean of the others; the stack's variance goes as
    sum (w^2 scatter) / (sum w)^2 over frames, with w a frame's mean weight.  gain is 1 - variance without / with: over zero where the frame does harm.
    """
    live = stack.samples.join(stack.removed.select("frame"), "frame", "left_anti")
    met = _null_safe(live, stack.cells.where("n > 1 and sw > 0"), stack.keys, ["sw", "swv", "med", "reach"], "inner")
    met = met.where("reach is null or abs(v - med) <= reach")
    others = F.col("sw") - F.col("w")
    off = F.col("v") - (F.col("swv") - F.col("w") * F.col("v")) / others
    frames = met.where(others > 1e-9).groupBy("frame").agg(F.count("*").alias("samples"), F.avg(off * off).alias("scatter"), F.avg("w").alias("w"))
    own = F.col("w") * F.col("w") * F.col("scatter")
    total = frames.agg(F.sum(own).alias("a"), F.sum("w").alias("b"))
    both = frames.crossJoin(F.broadcast(total))  # one row
    without = (F.col("a") - own) / F.pow(F.col("b") - F.col("w"), 2)
    gain = F.when((F.col("b") > F.col("w")) & (F.col("a") > 0), 1 - without * F.pow("b", 2) / F.col("a"))
    return both.select("frame", "samples", "scatter", (F.col("w") / F.col("b")).alias("share"), gain.alias("gain"))


def removable(harmful: DataFrame, frames: DataFrame, admitted: int, already: int, fraction: float = 0.1, least: int = 2, whole_block: bool = False) -> DataFrame:
    """(frame, removed, because): which harmful frames (frame) a pass may take out.

    frames (frame, panel, is_reference) are those still in the stack.  References of the normalisation stay; in a panel that would keep
    fewer than `least` frames, the first ones by name stay; of the rest, the first by name go while all removals keep
    within the fraction of the frames admitted at the start, unless a whole measured block goes.
    """
    rows = frames.join(harmful.select("frame").distinct().withColumn("harm", F.lit(True)), "frame", "left").withColumn("wants", F.coalesce("harm", F.lit(False)) & ~F.coalesce("is_reference", F.lit(False)))
    counted = rows.groupBy("panel").agg(F.count_if(~F.col("wants")).alias("stay"))
    rows = _null_safe(rows.where("harm"), counted, ["panel"], ["stay"])
    order = Window.partitionBy("panel").orderBy(F.desc("wants"), "frame")
    rows = rows.withColumn("held", F.col("wants") & (F.row_number().over(order) <= F.lit(least) - F.col("stay")))
    go = F.col("wants") & ~F.col("held")
    # harmful frames of one run: a list far smaller than the frames
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(go), "frame"))
    allowed = max(0, int(fraction * admitted) - already)
    over = F.lit(False) if whole_block else go & (rank > allowed)
    because = F.when(F.coalesce("is_reference", F.lit(False)), "REFERENCE").when(F.col("held"), "PANEL_MINIMUM").when(over, "FRACTION_GUARD")
    return rows.select("frame", because.isNull().alias("removed"), because.alias("because"))


def integrate(stack: Stack, panels: DataFrame, passes: int = 3, margin: float = 0.0, fraction: float = 0.1, judge: Callable[[Stack], DataFrame] | None = None) -> tuple[Stack, DataFrame]:
    """(last stack, (pass, frame, removed, because)): integrate, find the harmful frames, take them out, at most `passes` integrations.

    panels (frame, panel, is_reference) lists the admitted frames.  judge gives the harmful frames of a stack; by default
    those whose gain is over the margin.
    """
    judge = judge or (lambda s: harm(s).where(F.col("gain") > margin))
    admitted = panels.select("frame").distinct().count()
    log = None
    for turn in range(1, passes + 1):
        present = panels.join(stack.removed.select("frame"), "frame", "left_anti")
        said = cut(removable(judge(stack), present, admitted, stack.removed.count(), fraction).withColumn("pass", F.lit(turn)))
        log = said if log is None else log.unionByName(said)
        if turn == passes or not said.where("removed").head(1):
            break
        stack = remove(stack, said.where("removed").select("frame"))
    return stack, log.select("pass", "frame", "removed", "because")
