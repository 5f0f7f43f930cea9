"""Nearest matches, spatial joins, reconciliation and graphs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_or_unknown(a: Column, b: Column) -> Column:
    """The permissive test: an unknown value forbids nothing."""
    return F.coalesce(a == b, F.lit(True))


def same_and_known(a: Column, b: Column) -> Column:
    """The strict test: an unknown value proves nothing."""
    return F.coalesce(a == b, F.lit(False))


def keywords_compatible(left: Column, right: Column) -> Column:
    """Whether two maps agree on every key that both have."""
    return F.forall(F.map_keys(left), lambda k: same_or_unknown(F.element_at(left, k), F.element_at(right, k)))


#: Groups that best_match() and held() broadcast at most.
MOST_GROUPS = 100_000


def best_match(targets: DataFrame, key: str, groups: DataFrame, on: list[str], compatible: Column, rank: list[Column], tie: list[Column]) -> DataFrame:
    """Each target with its best compatible group and the number of `candidates`; targets without one keep nulls.

    Groups meet targets through the equality columns `on`; without such columns there may be at most
    MOST_GROUPS of them, which are counted and broadcast.  The best is an aggregate, so no target's matches are
    gathered; repeated targets stay apart.
    """
    if not on and groups.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups need equality columns")
    numbered = targets.withColumn("_row", F.monotonically_increasing_id())
    met = numbered.join(groups, on, "left") if on else numbered.join(F.broadcast(groups), compatible, "left")
    ok = F.coalesce(compatible, F.lit(False))
    order = F.struct(*rank, *tie)
    own, brought = targets.columns, [c for c in groups.columns if c not in on]
    best = met.groupBy("_row", *own).agg(F.count_if(ok).alias("candidates"), F.min_by(F.when(ok, F.struct(*brought)), F.when(ok, order)).alias("best"))
    return best.select(*own, "candidates", "best.*")


def ambiguous(targets: DataFrame, key: str, groups: DataFrame, on: list[str], compatible: Column, rank: list[Column]) -> DataFrame:
    """(key, best_count): how many compatible groups share the best rank of each target."""
    met = targets.join(groups, on).where(F.coalesce(compatible, F.lit(False))).withColumn("_r", F.struct(*rank))
    counts = met.groupBy(key, "_r").agg(F.count("*").alias("c"))
    return counts.groupBy(key).agg(F.min_by("c", "_r").alias("best_count"))


def _cells(df: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    return df.withColumns({"_cx": F.floor(F.col(x) / radius), "_cy": F.floor(F.col(y) / radius)})


def radius_pairs(left: DataFrame, right: DataFrame, keys: list[str], lid: str, rid: str, x: str, y: str, radius: float) -> DataFrame:
    """(keys, lid, rid, distance) of points within the radius: an equi-join on grid cells, the right side dealt to 9 cells.

    Ids are renamed to left_id and right_id; x and y have one name on both sides.
    """
    a = _cells(left.select(*keys, F.col(lid).alias("left_id"), F.col(x).alias("x1"), F.col(y).alias("y1")), "x1", "y1", radius)
    b = _cells(right.select(*keys, F.col(rid).alias("right_id"), F.col(x).alias("x2"), F.col(y).alias("y2")), "x2", "y2", radius)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = b.withColumn("_s", F.explode(steps)).withColumns({"_cx": F.col("_cx") + F.col("_s.i"), "_cy": F.col("_cy") + F.col("_s.j")}).drop("_s")
    met = a.join(b, [*keys, "_cx", "_cy"])
    d2 = F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)
    return met.withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius).select(*keys, "left_id", "right_id", "distance")


def mutual_nearest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs that are nearest to each other; ties go to the lower id."""
    left = pairs.groupBy(*keys, "left_id").agg(F.min(F.struct("distance", "right_id")).alias("m")).select(*keys, "left_id", F.col("m.right_id").alias("right_id"), F.col("m.distance").alias("distance"))
    right = pairs.groupBy(*keys, "right_id").agg(F.min(F.struct("distance", "left_id")).alias("m")).select(*keys, "right_id", F.col("m.left_id").alias("left_id"))
    return left.join(right, [*keys, "left_id", "right_id"])


def shared_path(spark) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("framestack.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("framestack.scratch", base)
    return f"{base}/framestack-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage and outlives executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """A table of a row a group, written out and, up to MOST_GROUPS rows, broadcast: rows of few groups then stay where they are."""
    written = cut(df)
    return F.broadcast(written) if written.count() <= MOST_GROUPS else written


def greedy_match(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches by rising distance: rounds of pairs that are best for both sides, until none is left.

    A pair best for both is what the sequential greedy would take at some point, so the rounds give
    its result; ties are by distance, left_id, right_id.
    """
    order = F.struct("distance", "left_id", "right_id")
    left, done = cut(pairs), None
    while left.head(1):
        a = left.withColumns({"_l": F.min(order).over(Window.partitionBy(*keys, "left_id")), "_o": order})
        a = a.withColumn("_r", F.min("_o").over(Window.partitionBy(*keys, "right_id")))
        taken = cut(a.where((F.col("_o") == F.col("_l")) & (F.col("_o") == F.col("_r"))).select(*pairs.columns))
        done = taken if done is None else done.unionByName(taken)
        left = cut(left.join(taken.select(*keys, "left_id"), [*keys, "left_id"], "left_anti").join(taken.select(*keys, "right_id"), [*keys, "right_id"], "left_anti").select(*pairs.columns))
    return done if done is not None else pairs.where("false")


#: Halvings of the radius that greedy_near() makes at most, and candidates for each point at which it starts.
MOST_BANDS, CANDIDATES = 12, 1


def greedy_near(left: DataFrame, right: DataFrame, keys: list[str], lid: str, rid: str, x: str, y: str, radius: float) -> DataFrame:
    """greedy_match() of radius_pairs(), without all those pairs: radii grow by twos, and points matched within one leave before the next.

    Greedy takes pairs by rising distance, so what it takes within a radius does not depend on pairs beyond.  The first radius
    is one whose cells hold few candidates for each point; what is left behind a radius has no pair within it, so pairs stay in
    proportion to points, save for points in one place.
    """
    own = lambda df, key: df.select(*keys, F.col(key), F.col(x), F.col(y))
    a, b, done = cut(own(left, lid)), cut(own(right, rid)), None
    points = a.count() + b.count()
    both = a.select(*keys, x, y, F.lit(1).alias("_l")).unionByName(b.select(*keys, x, y, F.lit(0).alias("_l")))
    band = 0
    while band < MOST_BANDS:
        cells = _cells(both, x, y, radius / 2**band).groupBy(*keys, "_cx", "_cy").agg(F.sum("_l").alias("l"), F.sum(1 - F.col("_l")).alias("r"))
        if (cells.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0) <= CANDIDATES * points:
            break
        band += 1
    for band in range(band, -1, -1):
        taken = greedy_match(radius_pairs(a, b, keys, lid, rid, x, y, radius / 2**band), keys)
        done = taken if done is None else done.unionByName(taken)
        if band:
            a = cut(a.join(taken.select(*keys, F.col("left_id").alias(lid)), [*keys, lid], "left_anti"))
            b = cut(b.join(taken.select(*keys, F.col("right_id").alias(rid)), [*keys, rid], "left_anti"))
    return done


def isolated(points: DataFrame, keys: list[str], key: str, x: str, y: str, radius: float) -> DataFrame:
    """The points without another one within the radius."""
    near = radius_pairs(points, points, keys, key, key, x, y, radius).where("left_id <> right_id").select(*keys, F.col("left_id").alias(key)).distinct()
    return points.join(near, [*keys, key], "left_anti")


def offset_votes(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, bin_size: float, top: int, flux: str, tie: str) -> DataFrame:
    """(keys, dx_bin, dy_bin, votes): the commonest rounded offset between the `top` brightest points of each side."""

    def bright(df: DataFrame, n: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.col(flux).desc(), F.col(tie))
        return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select(*keys, F.col(x).alias(f"x{n}"), F.col(y).alias(f"y{n}"))

    met = bright(left, "1").join(bright(right, "2"), keys)  # at most top squared pairs a key
    votes = met.groupBy(*keys, F.floor((F.col("x1") - F.col("x2")) / bin_size + 0.5).alias("dx_bin"), F.floor((F.col("y1") - F.col("y2")) / bin_size + 0.5).alias("dy_bin")).agg(F.count("*").alias("votes"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("m"), "dx_bin", "dy_bin")).alias("b"))
    return best.select(*keys, "b.dx_bin", "b.dy_bin", (-F.col("b.m")).alias("votes"))


def overlapping_boxes(boxes: DataFrame, key: str, low: list[str], high: list[str], cell: float, keys: list[str] = (), cells: list[float] | None = None) -> DataFrame:
    """(keys, a, b, area) of boxes that overlap: boxes meet in the cells of a grid; a pair counts in the first cell that both reach.

    The grid parts the first axis by `cell`, or every axis by its own one of `cells`.  Neither side is broadcast: boxes are
    dealt to cells and pairs are many where the files of boxes are small.
    """
    names = [f"_{i}" for i in range(len(low))]
    grid = dict(zip(names, cells or [cell]))
    own = boxes.select(*keys, F.col(key).alias("id"), *[F.col(c).alias(f"lo{n}") for c, n in zip(low, names)], *[F.col(c).alias(f"hi{n}") for c, n in zip(high, names)])
    dealt = own
    for n, size in grid.items():
        dealt = dealt.withColumn(f"cell{n}", F.explode(F.sequence(F.floor(F.col(f"lo{n}") / size), F.floor(F.col(f"hi{n}") / size))))
    a, b = dealt.alias("a"), dealt.hint("merge").alias("b")
    both = [*[f"cell{n}" for n in grid], *keys]
    sides = [F.least(F.col(f"a.hi{n}"), F.col(f"b.hi{n}")) - F.greatest(F.col(f"a.lo{n}"), F.col(f"b.lo{n}")) for n in names]
    first = [F.floor(F.greatest(F.col(f"a.lo{n}"), F.col(f"b.lo{n}")) / size) == F.col(f"a.cell{n}") for n, size in grid.items()]
    apart = [F.col("a.id") < F.col("b.id"), *[s > 0 for s in sides], *first]
    met = a.join(b, reduce(lambda p, q: p & q, [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in both], *apart]))
    return met.select(*[F.col(f"a.{k}") for k in keys], F.col("a.id").alias("a"), F.col("b.id").alias("b"), reduce(lambda p, q: p * q, sides).alias("area"))


def least_reached(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each node 0, 1, ... reaches over the edges a to b, from such nodes of edges before."""
    was = None
    while was is None or not np.array_equal(least, was):
        was = least.copy()
        # Ends of an edge are joined at their own least nodes, so that all that hangs from them follows.
        p, q = least[a], least[b]
        m = np.minimum(p, q)
        least = was.copy()
        np.minimum.at(least, p, m)
        np.minimum.at(least, q, m)
        least = least[least]
    return least


#: Edges that a task thins at once.
MOST_EDGES = 1 << 21


def _thinned(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same connections: every node with the least node it reaches, over MOST_EDGES edges of a task at a time."""

    def thin(table: pa.Table) -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
        least = least_reached(np.arange(len(nodes)), ends[: len(ends) // 2], ends[len(ends) // 2 :])
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[least], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            whole = pc.and_(pc.is_valid(batch["u"]), pc.is_valid(batch["v"]))
            yield batch.filter(pc.invert(whole))
            kept.append(batch.filter(whole))
            n += kept[-1].num_rows
            if n >= MOST_EDGES:
                kept = [thin(pa.Table.from_batches(kept))]
                n = kept[0].num_rows
                if n > MOST_EDGES // 2:
                    yield from kept
                    kept, n = [], 0
        if n:
            yield thin(pa.Table.from_batches(kept))

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable; rounds of neighbour minima and label jumps, each written out.

    Edges of whole numbers are thinned first to as few as keep every connection, in ever fewer tasks of up to MOST_EDGES.
    """
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    if {edges.schema[c].dataType.simpleString() for c in "uv"} == {"bigint"}:
        edges, before = cut(_thinned(edges)), None
        while (n := edges.count()) and (before is None or before > MOST_EDGES and n <= before // 2):
            edges, before = cut(_thinned(edges.repartition(-(-n // MOST_EDGES)))), n
    both = cut(edges.union(edges.select("v", "u")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        told = both.join(labels, both.v == labels.node).select(F.col("u").alias("node"), "component")
        least = labels.union(told).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(least.join(jump, "component", "left").select("node", F.least("component", "next").alias("component")))
        if not new.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").head(1):
            return new
        labels = new


def staged_duplicates(df: DataFrame, key: str, content: str, prefix: int = 65536) -> DataFrame:
    """(key, first): rows whose content another row has, with the smallest key of the equal ones.

    Sizes are compared first, then digests of a prefix, then whole digests, each only where the
    cheaper one repeats, so that most contents are never digested.
    """
    c = F.col(content)
    size = df.withColumn("_size", F.octet_length(c))
    repeated = size.groupBy("_size").agg(F.count("*").alias("n")).where("n > 1").select("_size")
    headed = size.join(repeated, "_size", "left_semi").withColumn("_head", F.md5(F.substring(c, 1, prefix).cast("binary")))
    heads = headed.groupBy("_size", "_head").agg(F.count("*").alias("n")).where("n > 1").select("_size", "_head")
    whole = headed.join(heads, ["_size", "_head"], "left_semi").select(key, F.sha2(c.cast("binary"), 256).alias("digest"))
    first = whole.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return whole.join(first, "digest").select(key, "first", "digest")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on a key with `state`: matched, missing (left only) or extra (right only)."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    met = a.join(b, key, "full_outer")
    state = F.when(F.col("_l").isNull(), "extra").when(F.col("_r").isNull(), "missing").otherwise("matched")
    return met.withColumn("state", state).drop("_l", "_r")


def via_bridge(edges: DataFrame) -> DataFrame:
    """(src, ref, bridge, m): edges of two hops through the bridge with most matches, matrices (9 doubles, by rows) multiplied."""
    a = edges.select("src", F.col("ref").alias("bridge"), F.col("m").alias("m1"), F.col("matches").alias("k1"))
    b = edges.select(F.col("src").alias("bridge"), "ref", F.col("m").alias("m2"), F.col("matches").alias("k2"))
    met = a.join(b, "bridge").where(F.col("src") != F.col("ref"))
    met = met.join(edges.select("src", "ref"), ["src", "ref"], "left_anti")
    product = F.array(*[sum((F.get("m2", F.lit(3 * i + k)) * F.get("m1", F.lit(3 * k + j)) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])
    best = met.groupBy("src", "ref").agg(F.max_by(F.struct("bridge", product.alias("m")), F.struct(F.least("k1", "k2"), F.col("bridge"))).alias("x"))
    return best.select("src", "ref", "x.bridge", "x.m")


def inherited(df: DataFrame, signature: str, value: str, quality: str) -> DataFrame:
    """df where missing values come from the row of the same signature with the best (lowest) quality."""
    best = df.where(F.col(value).isNotNull()).groupBy(signature).agg(F.min_by(value, F.struct(quality, value)).alias("_best"))
    return df.join(best, signature, "left").withColumn(value, F.coalesce(value, "_best")).drop("_best")
