"""Operator 12: the trie of conversation prefixes.

A node is a distinct sequence of first turns (role, text) of conversations, the root the empty one. Steps:

1. Turns are numbered inside their conversation by ``turn`` (null first; ties by the digest of role and text), by a range
   partition of all turns, so that a long conversation is many tasks' work.
2. A prefix's digest is the exclusive-or of 128-bit hashes of (turn digest, place), a scan over blocks of ``SPAN`` turns and
   over the blocks' totals. Prefixes are grouped by depth and digest, and every group is verified: all of it must have
   one SHA-256 of the last turn and one parent. By induction over depth a group is then one prefix; else the digests are drawn
   anew with other seeds.
3. Whole subtrees of up to ``SUBTREE`` turns of distinct conversations go to a shard together. A shard enumerates its prefix
   digests in a minimal perfect hash (``SlotTable``: levels of bits, a slot is a bit's rank; every slot stores its
   digest, and lookups compare it), scatters counts into flat numpy arrays by slot, and accumulates leaves and saved
   tokens through the array of parent slots, deepest level first.
4. The nodes above those subtrees (at most one for each ``SUBTREE`` turns and level) take their subtrees' totals and add
   them up along their ancestors by doubling: as many rounds as the depth above has binary digits.

No task holds a conversation or a subtree of unbounded size. The ids of conversations that end at a node are joined in blocks of
``4096`` numbers and hashed as a stream.

Null roles and texts count as empty, rows without a conversation id aren't part of any conversation. Repeated rows are turns of their own.
An empty table has no prefix and gives no node. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stored
from seqloom.operators.components import cut
from seqloom.operators.rank import numbered

#: Turns of distinct conversations below a node that is worked out in one shard.
SUBTREE = 256
#: Nodes of a shard: whole subtrees, as many as fit.
SHARD = 1 << 16
#: Turns of a block of the scan.
SPAN = 4096
NODE = ["depth", "x1", "x2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class SlotTable:
    """A minimal perfect hash of distinct rows of integers, built level by level: rows alone at a place of a level get that place's rank."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.empty_like(keys)
        self.levels: list[tuple[np.ndarray, int]] = []
        left, first = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys of a slot table must be distinct")
            size = 2 * len(left)
            at = self._place(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = np.where(alone, np.cumsum(alone) - 1, -1)
            placed = alone[at]
            self.keys[first + ranks[at[placed]]] = keys[left[placed]]
            self.levels.append((ranks, first))
            first += int(placed.sum())
            left = left[~placed]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(len(keys), (0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for c in range(keys.shape[1]):
            h = (h ^ keys[:, c].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of rows, -1 for rows that the table doesn't hold."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, (ranks, first) in enumerate(self.levels):
            rank = ranks[self._place(keys[open_], level, len(ranks))]
            hit = rank >= 0
            out[open_[hit]] = first + rank[hit]
            open_ = open_[~hit]
        known = np.flatnonzero(out >= 0)
        out[known[(self.keys[out[known]] != keys[known]).any(1)]] = -1
        return out


def accumulate(keys: np.ndarray, parents: np.ndarray, conv: np.ndarray, n_convs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node: its parent's conversation and whether the parent is in the shard, children, leaves and saved tokens of its subtree."""
    table = SlotTable(keys)
    slot, n = table.find(keys), len(keys)
    flat = {name: np.empty(n, np.int64) for name in ("conv", "saved", "depth", "parent")}
    flat["conv"][slot], flat["saved"][slot], flat["depth"][slot], flat["parent"][slot] = conv, (n_convs - 1) * words, keys[:, 0], table.find(parents)
    parent, saved, inside = flat["parent"], flat["saved"], flat["parent"] >= 0
    children = np.bincount(parent[inside], minlength=n)
    leaves = (children == 0).astype(np.int64)
    order = np.argsort(-flat["depth"], kind="stable")
    order = order[inside[order]]
    for level in np.split(order, np.flatnonzero(np.diff(flat["depth"][order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    return np.where(inside, flat["conv"][parent], -1)[slot], inside[slot], children[slot], leaves[slot], saved[slot]


def _number(batch: pa.Table, name: str) -> np.ndarray:
    return batch[name].to_numpy().astype(np.int64)


def _buffers(batches: Iterator[pa.RecordBatch], group: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups (rows of equal ``group`` follow each other), of about ``rows`` rows."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < rows:
            continue
        keys = np.stack([_number(held, c) for c in group], 1)
        n = int(np.flatnonzero((keys != keys[-1]).any(1))[-1]) + 1 if (keys != keys[-1]).any() else 0
        if n:
            yield held.slice(0, n)
            held = held.slice(n)
    if held is not None and held.num_rows:
        yield held


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _buffers(batches, ["s_depth", "s1", "s2"], SHARD):
        keys = np.stack([_number(t, c) for c in NODE], 1)
        parents = np.stack([_number(t, "depth") - 1, _number(t, "px1"), _number(t, "px2")], 1)
        above = keys[:, 0] == _number(t, "s_depth")
        parents[above] = -1  # a subtree's own top: its parent is no node of the shard
        found = accumulate(keys, parents, _number(t, "conv_id"), _number(t, "n_convs"), _number(t, "words"))
        parent_conv, inside, *rest = found
        columns = [t[c].combine_chunks() for c in (*NODE, "px1", "px2", "conv_id", "n_convs")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(parent_conv, mask=~inside), pa.array(above), *map(pa.array, rest)],
            [*NODE, "px1", "px2", "conv_id", "n_convs", "parent_conv_id", "above", "n_children", "n_leaves", "saved_tokens"],
        )


def rebuilt(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, turn, words, size): every conversation's first turns taken from conversation c - c % 20, then its own; a row of place 0 each, too.

    ``turn`` is the digest of role and text, ``size`` the number of turns.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("c"), F.col(turn).alias("at"),
        F.unhex(F.sha2(F.concat(F.octet_length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)), 256)).alias("turn"),
        F.regexp_count(empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    own = cut(numbered(own, ["c", "at", "turn", "words"], "n"))
    base = F.col("c") - F.col("c") % 20
    convs = own.groupBy("c").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("own")).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % 4).withColumn("base", base)
    convs = cut(convs)
    bases = convs.where("c = base").select("base", F.col("own").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = cut(convs.withColumn("size", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    turns = own.join(convs, "c").withColumn("nth", F.col("n") - F.col("first") + 1)
    rest = turns.where("nth > h").select("c", (F.col("lent") + F.col("nth") - F.col("h")).alias("pos"), "turn", "words", "size")
    lent = turns.where("c = base and nth <= 3").select("base", "nth", "turn", "words").join(convs.select("c", "base", "lent", "size"), "base").where("nth <= lent")
    root = convs.select("c", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("turn"), F.lit(0).cast("long").alias("words"), "size")
    return root.unionByName(rest).unionByName(lent.select("c", F.col("nth").alias("pos"), "turn", "words", "size"))


def prefixes(turns: DataFrame, seed: int = 0) -> DataFrame:
    """(c, depth, x1, x2, px1, px2, turn, words, size): each prefix of each conversation, with its digest and its parent's."""
    lane = lambda n: F.when(F.col("pos") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(2 * seed + n), "turn", "pos"))
    at = turns.withColumns({"block": F.expr(f"pos div {SPAN}"), "t1": lane(0), "t2": lane(1)})
    totals = at.where(F.col("size") >= SPAN).groupBy("c", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for SPAN turns
    totals = totals.select("c", "block", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2"))
    inside = Window.partitionBy("c", "block").orderBy("pos")
    at = at.withColumns({"x1": F.bit_xor("t1").over(inside), "x2": F.bit_xor("t2").over(inside)}).join(totals, ["c", "block"], "left")
    zero = F.lit(0).cast("long")
    at = at.withColumns({x: F.col(x).bitwiseXOR(F.coalesce(b, zero)) for x, b in (("x1", "b1"), ("x2", "b2"))})
    return at.select("c", F.col("pos").alias("depth"), "x1", "x2", *(F.col(x).bitwiseXOR(F.col(t)).alias(f"p{x}") for x, t in (("x1", "t1"), ("x2", "t2"))), "turn", "words", "size")


def _verified(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes, and nodes whose digests stand for one prefix each."""
    for seed in range(8):
        rows = stored(prefixes(turns, seed), "prefixes")
        # Equal conversations count once for the size of a subtree.
        ends = rows.where("depth = size").groupBy(*NODE).agg(F.min("c").alias("c")).select("c", F.lit(True).alias("one"))
        rows = stored(rows.join(ends, "c", "left").withColumn("one", F.coalesce("one", F.lit(False))), "paths")
        pair = lambda c: (F.min(c).alias(c), F.max(c).alias(f"{c}_"))
        nodes = rows.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.min("words").alias("words"), *pair("px1"), *pair("px2"), *pair("turn"),
            F.sum(F.when(F.col("one"), F.col("size") - F.col("depth") + 1)).alias("below"),
        )
        nodes = stored(nodes, "trie-nodes")
        if nodes.where("px1 <> px1_ or px2 <> px2_ or turn <> turn_").isEmpty():
            return rows, nodes.drop("px1_", "px2_", "turn", "turn_")
    raise RuntimeError("prefix digests collide with every seed")


def _ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ascending ids of the conversations that end at a node."""
    blocks = rows.where("depth = size").groupBy(*NODE, F.shiftright("c", 12).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*NODE, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], [*NODE, "ends_sha256"])

    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return dealt.mapInArrow(digests, "depth long, x1 long, x2 long, ends_sha256 string")


def _above(top: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes above the shards' subtrees: totals of the subtrees below them (``tops``), added up along ancestors by doubling."""
    key, up = F.struct(*NODE), F.struct((F.col("depth") - 1).alias("depth"), F.col("px1").alias("x1"), F.col("px2").alias("x2"))
    top = cut(top.select(key.alias("k"), F.when(F.col("depth") > 0, up).alias("parent"), "conv_id", "n_convs", "words"))
    below = tops.groupBy(up.alias("k")).agg(F.count(F.lit(1)).alias("c1"), F.sum("n_leaves").alias("l1"), F.sum("saved_tokens").alias("s1"))
    more = top.where("parent is not null").groupBy(F.col("parent").alias("k")).agg(F.count(F.lit(1)).alias("c2"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    top = top.join(below, "k", "left").join(more, "k", "left").select(
        "k", "parent", "conv_id", "n_convs", (zero("c1") + zero("c2")).alias("n_children"), zero("l1").alias("leaves"), (zero("s1") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    top = cut(top)
    state = top.select("k", F.col("parent").alias("up"), "leaves", "saved")
    while not state.where("up is not null").isEmpty():
        given = state.where("up is not null").groupBy(F.col("up").alias("k")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = state.select(F.col("k").alias("up"), F.col("up").alias("up2"))
        state = state.join(given, "k", "left").join(further, "up", "left")
        state = cut(state.select("k", F.col("up2").alias("up"), (F.col("leaves") + zero("l")).alias("leaves"), (F.col("saved") + zero("s")).alias("saved")))
    names = top.select(F.col("k").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = top.drop("leaves", "saved").join(state, "k").join(names, "parent", "left")
    return out.select("k.*", "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, subtree: int = SUBTREE, **columns: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row a node of the rebuilt conversations' trie."""
    rows, nodes = _verified(stored(rebuilt(conversations, **columns), "rebuilt"))
    small = nodes.where(F.col("below") <= subtree).select(*NODE)
    tops = rows.where("one").join(small, NODE).groupBy("c").agg(F.min(F.struct(*NODE)).alias("s")).select(F.col("c").alias("conv_id"), F.col("s.depth").alias("s_depth"), F.col("s.x1").alias("s1"), F.col("s.x2").alias("s2"))
    # A node's least conversation is one of those that count; one that ends above all small subtrees has none.
    nodes = cut(nodes.join(tops, "conv_id", "left"))
    closed = nodes.where("depth >= s_depth").repartition("s_depth", "s1", "s2").sortWithinPartitions("s_depth", "s1", "s2", "depth")
    names = "depth long, x1 long, x2 long, px1 long, px2 long, conv_id long, n_convs long, parent_conv_id long, above boolean, n_children long, n_leaves long, saved_tokens long"
    inner = cut(closed.select(*NODE, "px1", "px2", "conv_id", "n_convs", "words", "s_depth", "s1", "s2").mapInArrow(_shard, names))
    upper = cut(_above(nodes.where("s_depth is null or depth < s_depth"), inner.where("above and depth > 0")))
    parents = upper.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("px1"), F.col("x2").alias("px2"), F.col("conv_id").alias("over"))
    own = inner.where("not above").select(*upper.columns)
    linked = inner.where("above").drop("parent_conv_id").join(parents, ["depth", "px1", "px2"], "left").withColumnRenamed("over", "parent_conv_id").select(*upper.columns)
    whole = upper.unionByName(own).unionByName(linked).join(_ends(rows), NODE, "left")
    longs = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return whole.select(*(F.col(c).cast("long").alias(c) for c in longs), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
