"""SimHash fingerprints of word shingles and a binary-trie self-join that links near-equal ones.

fingerprints() is one narrow pass.  links() works on distinct fingerprints only, so copies cost
nothing.  At most `bits` of 64 bits may differ, so of bits + 1 equal blocks one is the same in
both: for each block the fingerprint is rotated to start with it, and a trie node of that depth is
joined with itself only.  Below, tries are traversed as node pairs that carry the differing bits so
far and end when these exceed the budget.  Node pairs with more than NODE_ROWS fingerprints are
first cut by further bits into child pairs, so no task holds an unbounded node.  A task returns pairs that
span the parts it has linked, fewer than it has fingerprints, and skips nodes that are linked already.

Null and empty texts, and texts without words, have fingerprint zero.  Repeated rows stay.

cluster() links single fingerprints.  near_groups() and deduplicated() ask for texts whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more; such texts differ in some ten of 64 bits,
out of reach of a budget that a trie can carry at scale.  There the tries link what differs in few bits,
a join on shared rare shingles adds the pairs that tries cannot reach, fingerprints of 128 bits drop those
that cannot be alike, and every link is confirmed by the exact similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, partitions, stored

#: Fingerprints of a node pair that one task may hold; larger node pairs are split by CUT_BITS more.
NODE_ROWS = 1 << 19
CUT_BITS = 8
#: Rows that a task gathers, to the end of a node pair, before it joins them.
CHUNK_ROWS = 1 << 17
#: Pairs of small nodes are compared at once; frontiers are expanded in pieces of this many node pairs.
SMALL_PAIRS, FRONTIER = 24, 1 << 17

_hash = partial(xxhash.xxh64_intdigest, seed=42)
_ONE = np.uint64(1)


def fingerprint(text: str | None, width: int) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and blanks are 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) < width:
        return _hash(b" ".join(words))
    n = len(words) - width + 1
    hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): fp holds the 64 bits as a signed number."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], [key, "fp"])

    rows = df.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, fp long")


# -- tries in a task ---------------------------------------------------------------------------


def merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (the smallest vertex of each part) after joining the pairs, and the indices of pairs that joined parts.

    In each round every part takes the pair that leads to the smallest label; these pairs form a
    spanning forest, so there are fewer of them than vertices.
    """
    label, index, used = label.copy(), np.arange(len(u)), []
    while len(index):
        a, b = label[u[index]], label[v[index]]
        apart = a != b
        index, lo, hi = index[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        if not len(index):
            break
        order = np.lexsort((lo, hi))
        first = order[np.concatenate(([True], hi[order][1:] != hi[order][:-1]))]
        label[hi[first]] = lo[first]
        used.append(index[first])
        while (label[label] != label).any():
            label = label[label]
    return label, np.concatenate(used) if used else np.empty(0, np.int64)


class Trie:
    """An implicit binary trie: a sorted array of codes, whose nodes are index ranges."""

    def __init__(self, codes: np.ndarray, budget: int):
        self.codes, self.budget = codes, budget
        self.label = np.arange(len(codes))
        self.found: list[np.ndarray] = []  # pairs that joined parts
        self.ones: dict[int, np.ndarray] = {}
        self._changes()

    def _changes(self) -> None:
        self.change = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def _bit(self, depth: int) -> np.ndarray:
        """Codes before each index whose bit at `depth` (from the top) is set."""
        if depth not in self.ones:
            bit = (self.codes >> np.uint64(63 - depth) & _ONE).astype(np.int32)
            self.ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
        return self.ones[depth]

    def _compare(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> None:
        """Every pair of codes in the given small ranges."""
        size = na * nb
        which = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        u, v = a[which] + step // nb[which], b[which] + step % nb[which]
        near = (u < v) & (np.bitwise_count(self.codes[u] ^ self.codes[v]) <= self.budget)
        u, v = u[near], v[near]
        label, used = merged(self.label, u, v)
        if len(used):
            self.label = label
            self.found.append(np.stack([u[used], v[used]]))
            self._changes()

    def join(self, pairs: np.ndarray, depth: int) -> None:
        """Traverse node pairs, rows (start, end, start, end, errors), all at `depth`, together."""
        stack = [(depth, pairs)]
        while stack:
            depth, p = stack.pop()
            if len(p) > FRONTIER:
                stack.append((depth, p[FRONTIER:]))
                p = p[:FRONTIER]
            a0, a1, b0, b1, err = p.T
            one = (self.label[a0] == self.label[b0]) & (self.change[a1 - 1] == self.change[a0]) & (self.change[b1 - 1] == self.change[b0])
            p = p[~one]  # all these are linked already
            a0, a1, b0, b1, err = p.T
            small = (a1 - a0) * (b1 - b0) <= SMALL_PAIRS
            if depth == 64:
                small[:] = True
            if small.any():
                self._compare(a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small])
                p = p[~small]
            if not len(p):
                continue
            a0, a1, b0, b1, err = p.T
            ones = self._bit(depth)
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            own = a0 == b0
            children = np.concatenate([
                np.stack([a0, am, b0, bm, err], 1),
                np.stack([am, a1, bm, b1, err], 1),
                np.stack([a0, am, bm, b1, err + 1], 1),
                np.stack([am, a1, b0, bm, err + 1], 1)[~own],
            ])
            a0, a1, b0, b1, err = children.T
            keep = (a1 > a0) & (b1 > b0) & (err <= self.budget) & ~((a0 == b0) & (a1 - a0 == 1))
            if keep.any():
                stack.append((depth + 1, children[keep]))


def join_groups(group: np.ndarray, side: np.ndarray, depth: np.ndarray, err: np.ndarray, codes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of code pairs within the budget that span the linked parts; rows of a group are one node pair.

    side 1 rows are the second node of a pair; a group without them is a node with itself.
    """
    order = np.lexsort((codes, side, group))
    group, side, depth, err, codes = group[order], side[order], depth[order], err[order], codes[order]
    trie = Trie(codes, budget)
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    end = np.append(edge[1:], len(group))
    ones = np.concatenate(([0], np.cumsum(side)))
    second = end - (ones[end] - ones[edge])
    alone = second == end
    pairs = np.stack([edge, np.where(alone, end, second), np.where(alone, edge, second), end, err[edge]], 1).astype(np.int64)
    for d in np.unique(depth):
        trie.join(pairs[depth[edge] == d], int(d))
    u, v = np.concatenate(trie.found, axis=1) if trie.found else np.empty((2, 0), np.int64)
    return order[u], order[v]


# -- tries over partitions ---------------------------------------------------------------------


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(np.uint64)


def _split(tasks: DataFrame, hot: DataFrame, budget: int) -> DataFrame:
    """Node pairs of hot groups, cut by CUT_BITS more bits into the child pairs within the budget."""
    group = ["block", "a", "b", "depth"]
    rows = tasks.join(hot.select(*group), group).withColumn(
        "child", F.expr(f"cast(shiftrightunsigned(shiftleft(code, depth), {64 - CUT_BITS}) as int)")
    )
    nodes = rows.groupBy(*group, "err", "side", "child").agg(F.lit(1).alias("one")).drop("one")
    left, right = nodes.where("side = 0").drop("side").withColumnRenamed("child", "ca"), nodes.drop("err")
    right = right.withColumnRenamed("child", "cb")
    own = F.col("a") == F.col("b")
    pairs = (
        left.join(right, group)
        .where((own & (F.col("ca") <= F.col("cb"))) | (~own & (F.col("side") == 1)))
        .withColumn("err", F.col("err") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))))
        .where(F.col("err") <= budget)
        .drop("side")
    )
    met = pairs.select(*group, "err", "ca", "cb", F.explode(F.when(own & (F.col("ca") == F.col("cb")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("to"))
    met = met.withColumn("child", F.when(F.col("to") == 0, F.col("ca")).otherwise(F.col("cb"))).withColumn("side", F.when(own, 0).otherwise(F.col("to")))
    out = rows.drop("err").join(met, [*group, "side", "child"])
    return out.select(
        "block",
        F.expr(f"a * {1 << CUT_BITS} + ca").alias("a"),
        F.expr(f"b * {1 << CUT_BITS} + cb").alias("b"),
        (F.col("depth") + CUT_BITS).alias("depth"),
        "err",
        F.col("to").alias("side"),
        "code",
    )


def links(fps: DataFrame, bits: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """(fp, root), also view if fps has one: pairs of distinct fingerprints with at most `bits` differing bits.

    Not all such pairs, but enough for the same connected parts; fingerprints of different views are
    never linked.
    """
    spark = fps.sparkSession
    width, blocks = 64 // (bits + 1), bits + 1
    views = "view" in fps.columns
    tasks = (
        fps.select("fp", (F.col("view") if views else F.lit(0)).alias("view"), F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("block"))
        .withColumn("code", F.expr(f"shiftleft(fp, block * {width}) | if(block = 0, 0L, shiftrightunsigned(fp, 64 - block * {width}))"))
        .withColumn("a", F.expr(f"shiftrightunsigned(code, {64 - width})"))
        .select((F.col("view") * blocks + F.col("block")).cast("int").alias("block"), "a", F.col("a").alias("b"), F.lit(width).alias("depth"), F.lit(0).alias("err"), F.lit(0).alias("side"), "code")
    )
    group = ["block", "a", "b", "depth"]
    cool = []
    for _ in range((64 - width) // CUT_BITS):
        hot = tasks.groupBy(*group).agg(F.count("*").alias("rows")).where(F.col("rows") > node_rows)
        hot = stored(hot, "hot")
        if not hot.head(1):
            break
        cool.append(tasks.join(hot.select(*group), group, "left_anti"))
        tasks = stored(_split(tasks, hot, bits), "split")
    for part in cool:
        tasks = tasks.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def answer(part: pa.Table) -> pa.RecordBatch:
            block, a, b, depth, err, side, code = (part.column(i).to_numpy() for i in range(7))
            change = (np.diff(block) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(depth) != 0)
            ids = np.concatenate(([0], np.cumsum(change)))
            codes = _unsigned(code)
            at, root = join_groups(ids, side, depth, err, codes, bits)
            back = (block % blocks * width).astype(np.uint64)
            whole = codes >> back | np.where(back > 0, codes << (np.uint64(64) - np.maximum(back, _ONE)), 0)
            return pa.RecordBatch.from_arrays([pa.array((block[at] // blocks).astype(np.int32)), pa.array(whole[at].view(np.int64)), pa.array(whole[root].view(np.int64))], ["view", "fp", "root"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < min(node_rows, CHUNK_ROWS):
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([part.column(i).to_numpy() for i in range(4)], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
            if not len(cut):
                continue
            yield answer(part.slice(0, cut[-1] + 1))
            held, rows = part.slice(cut[-1] + 1).to_batches(), part.num_rows - cut[-1] - 1
        if rows:
            yield answer(pa.Table.from_batches(held).combine_chunks())

    bounded_batches(spark, rows=1 << 15)
    dealt = tasks.repartition(partitions(spark), *group).sortWithinPartitions(*group)
    found = dealt.mapInArrow(run, "view int, fp long, root long").where("fp <> root")
    return found if views else found.drop("view")


def connected(edges: DataFrame) -> DataFrame:
    """(fp, label): one vertex of each connected part stands for it, for every vertex of edges (fp, root).

    Rounds of contraction: each vertex hooks onto its smallest neighbour if that is smaller
    (pre-aggregated), hooks are followed to their ends, and the edges between the ends, without loops
    and repeats, make the next round.  Edges shrink from round to round.
    """
    edges = stored(edges.select(F.least("fp", "root").alias("u"), F.greatest("fp", "root").alias("v")).where("u <> v").distinct(), "edges")
    labels = None
    while labels is None or edges.head(1):
        down = edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("to"))
        top = edges.select(F.col("u").alias("n")).distinct().join(down.select("n"), "n", "left_anti").select("n", F.col("n").alias("to"))
        hooks = stored(down.union(top), "hooks")
        while True:
            next_ = hooks.select(F.col("n").alias("to"), F.col("to").alias("end"))
            jumped = stored(hooks.join(next_, "to").select("n", F.col("end").alias("to"), (F.col("end") < F.col("to")).alias("moved")), "hooks")
            hooks = jumped.select("n", "to")
            if not jumped.where("moved").head(1):
                break
        if labels is None:
            labels = hooks.select(F.col("n").alias("fp"), F.col("to").alias("label"))
        else:
            further = hooks.select(F.col("n").alias("label"), "to")
            labels = stored(labels.join(further, "label", "left").select("fp", F.coalesce("to", "label").alias("label")), "labels")
        ends = hooks.select(F.col("n").alias("u"), F.col("to").alias("a"))
        moved = edges.join(ends, "u").join(ends.withColumnsRenamed({"u": "v", "a": "b"}), "v").where("a <> b")
        edges = stored(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    return labels


#: A value that more than one in HOT_SHARE rows have is hot; there are fewer than HOT_SHARE of those.
HOT_SHARE = 1000


def _with_hot(rows: DataFrame, known: DataFrame, on: str, counted: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """rows joined with known, which has one row for each value of `on`; hot values go by a broadcast of fewer than `share` rows."""
    counts = counted.groupBy(on).agg(F.count("*").alias("_n"))
    total = counted.count()
    hot = F.broadcast(stored(known.join(counts.where(F.col("_n") * share > total).select(on), on, "left_semi"), "hot"))
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(known, on))


def cluster(df: DataFrame, width: int = 3, bits: int = 3, key: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links."""
    prints = stored(fingerprints(df, width, key, text), "fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    labels = connected(links(first, bits, node_rows))
    bounded_batches(df.sparkSession)
    ids = labels.join(first, "fp").groupBy("label").agg(F.min("first").alias("component_id"))
    known = labels.join(ids, "label").select("fp", "component_id")
    known = first.join(known, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return _with_hot(prints, known, "fp", prints).select(key, "fp", "component_id")


# -- texts alike by their shingles ---------------------------------------------------------------

#: Words of a shingle; texts are alike if ALIKE[0] / ALIKE[1] of their shingles are shared.
WORDS, ALIKE = 5, (4, 5)
#: Bits within which the tries link the fingerprints of whole sets.
SET_BITS = 3
#: The bits of a hash that find its shingle's count (16 MB), and the entries of a part of the counts; results do not depend on either.
COUNT_BITS, PART = 24, 1 << 16
#: Bits of a set's parities, whose differences between two sets are no more than the shingles that only one of them has.
PARITIES = 1024
#: Sets of a shingle's other parts that each set meets before parts meet wholly; results do not depend on it.
NEIGHBOURS = 8
#: Sets of FILTER_FROM shingles or more are not compared if they differ in over FAR of 128 bits.  At a similarity of
#: 0.8 a bit differs with probability 0.152, so that fewer than one such pair in a million is lost.
FAR, FILTER_FROM = 44, 32
#: Shingles whose bits are summed at once.
SUM_ROWS = 1 << 13
#: Hubs of pairs whose sets are broadcast: those in over 1 / HUBS of the pairs and of at most HUB_SIZE shingles, so below 32 MB together.
HUBS, HUB_SIZE = 64, 1 << 16


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted hashes of the set of shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(width))))) or {b" ".join(words)}
    return np.unique(np.fromiter(map(_hash, shingles), np.uint64, len(shingles)))


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed=42)


def set_prints(hashes: np.ndarray) -> np.ndarray:
    """Two fingerprints of a set, by its hashes and by those mixed once more; zero for the empty set."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), SUM_ROWS):
        h = hashes[at : at + SUM_ROWS]
        mixed = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        both = np.stack([h, mixed ^ mixed >> np.uint64(29)], 1)
        ones += np.unpackbits(both.view(np.uint8).reshape(len(h), 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls on each of PARITIES places."""
    odd = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(items: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(i) for i in items]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*items, np.empty(0, np.uint64)]).view(np.int64)))


def _ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([_set_id(h) for h in sets], np.uint64).view(np.int64))


def _described(df: DataFrame, width: int, counts) -> DataFrame:
    """(key, sig, size, fp, fp2, prefix, odd) of rows (key, text): number, size, fingerprints, first shingles and parities of each set."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            prints = np.array([set_prints(h) for h in sets], np.int64).reshape(-1, 2)
            columns = [batch.column(0), _ids(sets), pa.array([len(h) for h in sets], pa.int32()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _lists([prefix(h, counts.value) for h in sets]), _lists([parities(h) for h in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sig", "size", "fp", "fp2", "prefix", "odd"])

    return df.mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, sig long, size int, fp long, fp2 long, prefix array<long>, odd array<long>")


def _whole_sets(df: DataFrame, width: int) -> DataFrame:
    """(sig, hashes) of rows (key, text)."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_ids(sets), _lists(sets)], ["sig", "hashes"])

    return df.select("text").mapInArrow(run, "sig long, hashes array<long>")


def with_set_id(df: DataFrame, width: int = WORDS, text: str = "text", name: str = "sig") -> DataFrame:
    """df and the number of its text's set of shingles."""
    bounded_batches(df.sparkSession)
    names, place = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(None if t is None else str(t), width) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _ids(sets)], [*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{name}` long")


def _counted(df: DataFrame, width: int):
    """A broadcast table of how often shingles come in all rows (key, text): COUNT_BITS of the hash, each an eighth of a power of two.

    A task adds up its rows in one table and hands it on in compressed parts of PART entries; parts are added as they are read.
    Its size does not depend on the corpus; shingles that share an entry share their count.
    """
    spark = df.sparkSession
    bounded_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNT_BITS, np.uint16)
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            entry, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(64 - COUNT_BITS), return_counts=True)
            entry = entry.astype(np.int64)
            table[entry] = np.minimum(table[entry] + n, 65535)
        for at in range(0, len(table), PART):
            part = table[at : at + PART]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // PART], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scaled() -> pa.RecordBatch:
            code = np.minimum(np.rint(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([code.tobytes()], pa.binary())], ["part", "counts"])

        now, total = None, None
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    if now is not None:
                        yield scaled()
                    now, total = part, np.zeros(PART, np.int64)
                total += np.frombuffer(zlib.decompress(counts), np.uint16)
        if now is not None:
            yield scaled()

    schema = "part int, counts binary"
    parts = df.select("text").mapInArrow(count, schema).repartition(partitions(spark), "part").sortWithinPartitions("part")
    got = parts.mapInArrow(add, schema).toArrow()  # a byte an entry
    table = np.zeros(1 << COUNT_BITS, np.uint8)
    for part, counts in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        table[part * PART : (part + 1) * PART] = np.frombuffer(counts, np.uint8)
    return spark.sparkContext.broadcast(table)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many of a set's hashes, rare ones first, that two sets as alike as ALIKE have one of them in common."""
    n = len(hashes) - -(-ALIKE[0] * len(hashes) // ALIKE[1]) + 1
    if not len(hashes):
        return hashes
    shift = np.uint64(64 - (len(counts).bit_length() - 1))
    return hashes[np.lexsort((hashes, counts[(hashes >> shift).astype(np.int64)]))][:n]


def _may_be_alike(a: str, b: str) -> Column:
    """Whether two sets (structs with size, fp, fp2, and the place of a shared shingle in the order of each) may be ALIKE.

    If the shingle is the first one shared, no more are shared than follow it in either set: a pair that fails this at its
    first shared shingle is not alike, so pairs that are alike pass there.  Then sizes, and the fingerprints.
    """
    share = F.least(F.col(f"{a}.size") - F.col(f"{a}.pos"), F.col(f"{b}.size") - F.col(f"{b}.pos"))  # itself and what follows
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    bits = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) + F.bit_count(F.col(f"{a}.fp2").bitwiseXOR(F.col(f"{b}.fp2")))
    least, most = F.least(size_a, size_b), F.greatest(size_a, size_b)
    enough = share * (ALIKE[0] + ALIKE[1]) >= (least + most) * ALIKE[0]
    return (least * ALIKE[1] >= most * ALIKE[0]) & enough & ((least < FILTER_FROM) | (bits <= FAR))


def _few_differ(a: str, b: str) -> Column:
    """Whether the parities of two sets (structs with size and odd) leave room for ALIKE: loses nothing, as each differing place holds a shingle that only one set has."""
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.get(f"{a}.odd", F.lit(i)).bitwiseXOR(F.get(f"{b}.odd", F.lit(i)))) for i in range(PARITIES // 64)])
    return differ * (ALIKE[0] + ALIKE[1]) <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * (ALIKE[1] - ALIKE[0])


def _alike(pairs: DataFrame, one: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Pairs (u, v) whose sets have a Jaccard similarity of at least ALIKE; texts are read again for the sets in pairs only."""
    met = pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct()
    wanted = stored(one.join(met, "sig", "left_semi").select("sig", "first"), "wanted")
    picked = docs.join(wanted, docs["key"].eqNullSafe(wanted["first"]), "left_semi")
    sets = stored(_whole_sets(picked, width).join(wanted, "sig", "left_semi").dropDuplicates(["sig"]), "whole_sets")
    small = sets.where(F.size("hashes") <= HUB_SIZE)
    large = sets.where(F.size("hashes") > HUB_SIZE)

    def side(rows: DataFrame, n: str) -> DataFrame:
        named = lambda s: s.select(F.col("sig").alias(n), F.col("hashes").alias(f"h{n}"))
        return _with_hot(rows, named(small), n, pairs, HUBS).unionByName(rows.join(named(large), n))

    both = side(side(pairs, "u"), "v").select("u", "v", F.size(F.array_intersect("hu", "hv")).alias("shared"), (F.size("hu") + F.size("hv")).alias("sizes"))
    return stored(both.where(F.col("shared") * ALIKE[1] >= (F.col("sizes") - F.col("shared")) * ALIKE[0]).select("u", "v"), "alike")


def _trie_pairs(one: DataFrame, bits: int, node_rows: int) -> DataFrame:
    """(u, v) of sets whose fingerprints are linked; sets of one fingerprint meet the smallest of them."""
    lowest = stored(one.groupBy("fp").agg(F.min("sig").alias("v")), "codes")
    same = one.select("sig", "fp").join(lowest, "fp").select(F.col("sig").alias("u"), "v")
    ends = links(lowest.select("fp"), bits, node_rows).join(lowest.withColumnRenamed("v", "u"), "fp").select("u", F.col("root").alias("fp")).join(lowest, "fp").select("u", "v")
    return same.union(ends).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def set_labels(rows: DataFrame, one: DataFrame, docs: DataFrame, width: int, bits: int, node_rows: int) -> DataFrame:
    """(fp, label) as connected() gives them, for the graph of all sets of shingles that are alike; fp is the set's number.

    Sets that share a shingle of their prefixes may be alike, all others cannot be.  First the tries' pairs, and
    those of each set with at most three of its shingles' hubs, are confirmed.  Confirmed parts meet no more: the second
    round confirms a few neighbours of other parts, and the last one all pairs of a shingle that lie in different parts and differ in few enough parities.
    """
    me = lambda: F.struct("sig", "size", "fp", "fp2", "pos")
    by_token = Window.partitionBy("token")
    kept = rows.select("sig", "size", "fp", "fp2", "prefix").dropDuplicates(["sig"])  # copies end in the map tasks
    posted = kept.select("sig", "size", "fp", "fp2", F.posexplode("prefix").alias("pos", "token")).repartition("token").withColumn("me", me())
    hubs = {"lo": F.min("sig").over(by_token), "hi": F.max("sig").over(by_token), "hub_a": F.min_by("me", "sig").over(by_token), "hub_b": F.min_by("me", F.xxhash64("sig", "token")).over(by_token)}
    met = posted.withColumns(hubs).where("lo <> hi")
    near = lambda hub: F.when((F.col(f"{hub}.sig") != F.col("sig")) & _may_be_alike("me", hub), F.col(f"{hub}.sig"))
    shared = stored(met.select("token", "sig", "size", "fp", "fp2", "pos", near("hub_a").alias("hub_a"), near("hub_b").alias("hub_b")), "shared")
    hubs = shared.groupBy("sig").agg(F.array_compact(F.array(F.min("hub_a"), F.max("hub_a"), F.min("hub_b"))).alias("hubs"))  # three at most
    starred = hubs.select("sig", F.explode("hubs").alias("hub")).select(F.least("sig", "hub").alias("u"), F.greatest("sig", "hub").alias("v"))
    pairs = stored(starred.union(_trie_pairs(one, bits, node_rows)).distinct(), "pairs")
    edges = _alike(pairs, one, docs, width)
    labels = connected(edges.select(F.col("u").alias("fp"), F.col("v").alias("root")))
    odd = rows.select("sig", "odd").dropDuplicates(["sig"])
    one_of = lambda df: df.withColumns({"lo": F.min("label").over(by_token), "hi": F.max("label").over(by_token)}).where("lo <> hi").drop("lo", "hi")
    named = shared.drop("hub_a", "hub_b").join(labels.withColumnRenamed("fp", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    you = F.struct("sig", "size", "fp", "fp2", "pos", "odd")
    apart = stored(one_of(named).join(odd, "sig").select("token", "sig", you.alias("me"), "label"), "apart")
    # Every set meets the NEIGHBOURS next ones of each shingle in a random order, and up to four of those of other parts
    # that may be alike are confirmed: in large families most alike parts then grow together before all their pairs would meet.
    by_chance = by_token.orderBy(F.xxhash64("sig", "token"), "sig")
    nexts = apart.withColumns({f"n{k}": F.lead(F.struct("me", "label"), k).over(by_chance) for k in range(1, NEIGHBOURS + 1)})
    near = lambda c: F.when((F.col(f"{c}.label") != F.col("label")) & _may_be_alike("me", f"{c}.me") & _few_differ("me", f"{c}.me"), F.col(f"{c}.me.sig"))
    found = nexts.select("sig", F.explode(F.array_compact(F.array(*[near(f"n{k}") for k in range(1, NEIGHBOURS + 1)]))).alias("to"))
    four = found.groupBy("sig").agg(F.array(F.min("to"), F.max("to"), F.min_by("to", F.xxhash64("to", "sig")), F.max_by("to", F.xxhash64("to", "sig"))).alias("to"))
    starred = four.select("sig", F.explode("to").alias("to")).select(F.least("sig", "to").alias("u"), F.greatest("sig", "to").alias("v")).distinct()
    further = stored(starred.join(pairs, ["u", "v"], "left_anti"), "further")
    edges = edges.union(_alike(further, one, docs, width))
    labels = connected(edges.select(F.col("u").alias("fp"), F.col("v").alias("root")))
    told = apart.drop("label").join(labels.withColumnRenamed("fp", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    a = stored(one_of(told).select("token", F.col("me").alias("a"), F.col("label").alias("la")), "still_apart")
    b = a.withColumnsRenamed({"a": "b", "la": "lb"})
    rest = a.join(b, "token").where((F.col("a.sig") < F.col("b.sig")) & (F.col("la") != F.col("lb")) & _may_be_alike("a", "b") & _few_differ("a", "b")).select(F.col("a.sig").alias("u"), F.col("b.sig").alias("v")).distinct()
    rest = stored(rest.join(pairs.union(further), ["u", "v"], "left_anti"), "rest")
    more = _alike(rest, one, docs, width)
    if not more.head(1):
        return labels
    return connected(edges.union(more).select(F.col("u").alias("fp"), F.col("v").alias("root")))


def _parts(df: DataFrame, key: str, text: str, width: int, bits: int, node_rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, sig) of each row of df, and (sig, first, label): of each set of shingles the smallest key and its part."""
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = stored(_described(docs, width, _counted(docs, width)), "described")
    one = stored(rows.groupBy("sig").agg(F.min("key").alias("first"), F.min("fp").alias("fp")), "distinct")
    known = set_labels(rows, one, docs, width, bits, node_rows).withColumnRenamed("fp", "sig")
    bounded_batches(df.sparkSession)
    return rows.select("key", "sig"), one.select("sig", "first").join(known, "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def near_groups(df: DataFrame, width: int = WORDS, bits: int = SET_BITS, key: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """(key, component_id): the smallest key reachable over pairs of texts that are alike; copies meet in an aggregate."""
    rows, parts = _parts(df, key, text, width, bits, node_rows)
    parts = stored(parts, "parts")
    ids = parts.groupBy("label").agg(F.min("first").alias("component_id"))
    return _with_hot(rows, parts.join(ids, "label").select("sig", "component_id"), "sig", rows).select(F.col("key").alias(key), "component_id")


def deduplicated(df: DataFrame, width: int = WORDS, bits: int = SET_BITS, key: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """df without the documents that near-repeat one with a smaller key; of rows that share the key and the shingles one stays.

    Rows without words are copies of each other.  Different texts under one key, or none, are different rows.
    """
    rows, parts = _parts(df, key, text, width, bits, node_rows)
    parts = stored(parts, "parts")
    least = F.min_by(F.struct("sig", "first"), F.struct(F.col("first").isNull(), "first", "sig"))
    stay = parts.groupBy("label").agg(least.alias("one")).select("one.sig", F.col("one.first").alias("key"))
    sig, name, none = (free_name(df.columns, n) for n in ("sig", "name", "none"))
    # A null key as two columns without nulls: the join and the aggregate then share one shuffle of the texts.
    named = lambda c: [F.coalesce(c.cast("string"), F.lit("")).alias(name), c.isNull().alias(none)]
    every = rows.select(F.col("sig").alias(sig), *named(F.col("key"))).distinct()
    goes = stored(every.join(stay.select(F.col("sig").alias(sig), *named(F.col("key"))), [sig, name, none], "left_anti"), "goes")
    tagged = with_set_id(df, width, text, sig).select("*", *named(F.col(key)))
    return tagged.join(goes, [sig, name, none], "left_anti").dropDuplicates([sig, name, none]).select(*df.columns)
