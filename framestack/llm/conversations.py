"""Prefix trie of conversations, merged family by family.

A family is a base conversation (its id divides by FAMILY) with the conversations that branch from it.  The rows
of a base and of its branches are brought together by base id: a cogroup whose sides are read one behind the
other, base first, in sorted order, so a task holds the first turns of one base and the nodes of one small
trie, never a whole family.  Each branch is rebuilt (the base's first turns, then its own), each family's trie is
built on the spot, and only its combined nodes are shuffled for the global merge; texts are never shuffled, as
a turn counts by the digest of its role and text.

Sums over subtrees take a second pass of the same kind.  A node belongs to the family of its smallest member,
whose trie holds all its ancestors; each family adds up what its own nodes give, from the deepest level
upwards, holding one level at a time, and the families' sums are merged by node.  No step goes level by level
over the whole trie, and no hot prefix is gathered: merges combine before the shuffle, look-ups of a parent are
salted, and the members that end at a node are joined in chunks of ids before their digest is taken in one stream.

Rows: a row without a conv_id belongs to no conversation and is left out; a null role or text counts as empty, a
null turn comes first; rows of equal turn are ordered by the digest of role and text, and repeated rows are
repeated turns.  ``%`` is SQL's (the sign of the left side).  An empty table has no members, so no root and no rows.
Only the four columns named are read; others can have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, with_totals

FAMILY, HEADS = 20, 4
#: Nodes that a family's trie holds before it is handed on; parts of a trie merge like tries, so results do not depend on it.
HELD = 1 << 17
#: Families whose members are joined in one text, rows of a batch to Spark.
CHUNK, BATCH = 64, 4096
WORD = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.sha256(b"").digest()[:16]

_NODES = "family long, node binary, parent binary, depth long, conv_id long, n_convs long, n_words long, ends array<long>"
_SUMS = "node binary, saved_tokens long, n_leaves long"


def turns(df: DataFrame) -> DataFrame:
    """(family, conv_id, turn, said, n_words): a row for each turn, its digest in place of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), "conv_id", "turn", said.alias("said"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))


def heads(conv_id: int) -> int:
    """How many of the base's first turns a conversation takes over."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


class _Trie:
    """A family's nodes: key to [parent, depth, smallest member, members, words, ends]."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}

    def visit(self, conv: int, key: bytes, parent: bytes | None, depth: int, words: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [parent, depth, conv, 1, words, []]
        else:
            node[2] = min(node[2], conv)
            node[3] += 1

    def end(self, conv: int, key: bytes) -> None:
        self.nodes[key][5].append(conv)

    def batches(self, family: int) -> Iterator[pa.RecordBatch]:
        items = list(self.nodes.items())
        self.nodes = {}
        for i in range(0, len(items), BATCH):
            part = items[i : i + BATCH]
            columns = [[family] * len(part), [k for k, _ in part], *([v[j] for _, v in part] for j in (0, 1, 2, 3, 4)), [sorted(v[5]) for _, v in part]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["family", "node", "parent", "depth", "conv_id", "n_convs", "n_words", "ends"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Family nodes of turns sorted by family, base first, conversation and turn."""
    trie = _Trie()
    family = conv = None
    opening: list[tuple[bytes, int]] = []  # the first turns of the family's base
    key, depth, place, take = ROOT, 0, 0, 0

    def step(said: bytes, words: int) -> None:
        nonlocal key, depth
        parent, depth = key, depth + 1
        key = hashlib.sha256(parent + said).digest()[:16]
        trie.visit(conv, key, parent, depth, words)

    for batch in batches:
        for fam, c, said, words in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if c != conv or fam != family:
                if conv is not None:
                    trie.end(conv, key)
                if fam != family or len(trie.nodes) >= HELD:
                    yield from trie.batches(family)
                if fam != family:
                    family, opening = fam, []
                conv, key, depth, place = c, ROOT, 0, 0
                take = heads(c) if c != family else 0
                trie.visit(conv, key, None, 0, 0)
                for head in opening[:take]:
                    step(*head)
            if c == family and place < HEADS - 1:
                opening.append((said, words))
            if place >= take:
                step(said, words)
                if len(trie.nodes) >= HELD:
                    last = trie.nodes.pop(key)
                    yield from trie.batches(family)
                    trie.nodes[key] = last
            place += 1
    if conv is not None:
        trie.end(conv, key)
        yield from trie.batches(family)


def rebuilt(df: DataFrame) -> DataFrame:
    """The combined nodes of each family of conversations (conv_id, turn, role, text), one row a family and node.

    A trie of more than HELD nodes comes in parts, whose rows add up.
    """
    rows = turns(df).repartition(partitions(df.sparkSession), "family")
    order = ["family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "said"]
    return rows.sortWithinPartitions(*order).mapInArrow(_families, _NODES)


def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each node's subtree gives within its family; rows sorted by family, deepest first, node."""
    family = level = key = above = None
    here: dict[bytes, list[int]] = {}  # sums of the level below, by parent
    there: dict[bytes, list[int]] = {}
    total = [0, 0]
    out: list[tuple] = []

    def close() -> None:
        if key is not None and any(total):
            out.append((key, *total))
            if above is not None:
                sums = there.setdefault(above, [0, 0])
                sums[0] += total[0]
                sums[1] += total[1]

    def made() -> pa.RecordBatch:
        rows = list(zip(*out)) or [[], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.binary(), pa.int64(), pa.int64()))], ["node", "saved_tokens", "n_leaves"])

    for batch in batches:
        for fam, depth, node, parent, saved, leaf in zip(*(c.to_pylist() for c in batch.columns)):
            if fam != family or node != key:
                close()
                if fam != family:
                    here, there = {}, {}
                elif depth != level:
                    here, there = there, {}
                family, level, key, above = fam, depth, node, parent
                total = here.pop(node, [0, 0])
            total = [total[0] + saved, total[1] + leaf]
        if len(out) >= BATCH:
            yield made()
    close()
    yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts in a row, comma-joined; a node's rows come one behind the other."""
    node, state, out = None, None, []

    def made() -> pa.RecordBatch:
        rows = list(zip(*out)) or [[], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.string())], ["node", "ends_sha256"])

    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key == node:
                state.update(b",")
            else:
                if state:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if len(out) >= BATCH:
            yield made()
    if state:
        out.append((node, state.hexdigest()))
    yield made()


def _ends(nodes: DataFrame, parts: int) -> DataFrame:
    """(node, ends_sha256) of nodes at which members end."""
    chunk = F.floor(F.col("family") / (FAMILY * CHUNK))
    ended = nodes.where(F.size("ends") > 0).groupBy("node", chunk.alias("chunk"))
    ids = F.array_sort(F.flatten(F.collect_list("ends")))
    joined = ended.agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"))
    return joined.repartition(parts, "node").sortWithinPartitions("node", "chunk").mapInArrow(_digests, "node binary, ends_sha256 string")


def trie(nodes: DataFrame) -> DataFrame:
    """The merged trie of rebuilt() families, one row a node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the binary keys node and parent (root: null)."""
    parts = partitions(nodes.sparkSession)
    nodes = stored(nodes, "families")
    whole = nodes.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("n_words").alias("n_words"), F.sum(F.size("ends")).alias("n_ends")
    )
    whole = stored(whole, "nodes")
    owner = F.col("conv_id") - F.col("conv_id") % FAMILY
    given = whole.select(owner.alias("family"), "depth", "node", "parent", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf"))
    paths = nodes.select("family", "depth", "node", "parent", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"))
    grown = given.union(paths).repartition(parts, "family").sortWithinPartitions("family", F.desc("depth"), "node").mapInArrow(_upward, _SUMS)
    children = whole.where("parent is not null")
    counted = grown.withColumn("n_children", F.lit(0).cast("long")).union(children.select("parent", F.lit(0), F.lit(0), F.lit(1)))
    sums = counted.groupBy("node").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"), F.sum("n_children").alias("n_children"))
    asked = children.select(F.col("parent").alias("at"), F.col("node").alias("child"), F.lit(None).cast("long").alias("conv"))
    told = whole.select(F.col("node").alias("at"), F.lit(None).cast("binary").alias("child"), F.col("conv_id").alias("conv"))
    parents = with_totals(asked.union(told), ["at"], F.xxhash64("child"), {"parent_conv_id": "conv"}, F.max).where("child is not null")
    joined = whole.join(sums, "node").join(parents.select(F.col("child").alias("node"), "parent_conv_id"), "node", "left").join(_ends(nodes, parts), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "node", "parent")
