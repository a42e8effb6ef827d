"""Operator 3: shards of near equal bytes by best-fit-decreasing bin packing.

Documents of equal text form a group, which is never split. Groups, sorted by size,
enter the bin with the tightest remaining capacity that holds them, found in a
balanced tree of the open bins; the capacity is the least for which no more than the
wanted number of bins is opened (by bisection). A group above the fair share gets a
bin of its own, and the others share the rest.

At scale the groups don't fit one machine, so packing has two levels. ``GRAIN`` parts
of a shard's fair size make a grain. Groups of a grain or more are few (at most
``shards * GRAIN``). Smaller ones are packed, by the same method and where Spark's
shuffle has put them, into bundles of a grain; at most one bundle a task is less than
half full. Only large groups and bundles, whose number is bounded by the shards and
the tasks, are packed on the driver. A group with many rows is large, since every row
counts 16 bytes at least, so the rows joined by shuffle have no hot key.

Slots number each shard's rows without gaps: rows are numbered inside ``SLICES``
hashed slices of each shard, after the rows of earlier slices.

Null texts have size 0 plus 16 and the group and checksum of the empty text. Repeated
rows are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stored

GRAIN = 250
SLICES = 256
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


class Bins:
    """A treap of (remaining capacity, bin): balanced by random priorities."""

    def __init__(self, seed: int = 7):
        self.random = random.Random(seed).random
        self.root = None

    def _split(self, node, key):
        """Nodes below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, remaining: int, bin_no: int) -> None:
        low, high = self._split(self.root, (remaining, bin_no))
        self.root = self._join(self._join(low, [(remaining, bin_no), self.random(), None, None]), high)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``need``."""
        best, node = None, self.root
        while node is not None:
            if node[0][0] >= need:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, rest = self._split(self.root, best)
            _, high = self._split(rest, (best[0], best[1] + 1))
            self.root = self._join(low, high)
        return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """A bin for each size; None if more than ``most`` bins are needed. No size may exceed the capacity."""
    out, bins, opened = np.empty(len(sizes), np.int64), Bins(), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        hit = bins.take(need)
        if hit is None:
            if opened == most:
                return None
            hit, opened = (capacity, opened), opened + 1
        out[i] = hit[1]
        bins.add(hit[0] - need, hit[1])
    return out


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each size: the least capacity at which best fit decreasing needs no more than ``shards``."""
    out = np.full(len(sizes), -1, np.int64)
    left, alone = shards, 0
    order = np.argsort(-sizes, kind="stable")
    rest = int(sizes.sum())
    while alone < len(order) and left > 1 and int(sizes[order[alone]]) * left > rest:  # above the fair share
        out[order[alone]] = alone
        rest -= int(sizes[order[alone]])
        left, alone = left - 1, alone + 1
    some = order[alone:]
    if not len(some):
        return out
    own = sizes[some]
    low = max(int(own.max()), -(-int(own.sum()) // left))
    high, found = low, None
    while found is None:  # some capacity will do
        found = best_fit_decreasing(own, high, left)
        if found is None:
            low, high = high + 1, high + max(1, high // 1000)
    while low < high and high - low > high // 100_000:
        middle = (low + high) // 2
        attempt = best_fit_decreasing(own, middle, left)
        if attempt is None:
            low = middle + 1
        else:
            found, high = attempt, middle
    out[some] = found + alone
    return out


def _bundles(groups: DataFrame, grain: int) -> DataFrame:
    """(grp, bytes, bundle) of the small groups; bundles are numbered apart in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # the small groups of one shuffle partition: 50 bytes each
        if got:
            t = pa.Table.from_batches(got)
            sizes = t["bytes"].to_numpy()
            bundle = best_fit_decreasing(sizes, grain) + (TaskContext.get().partitionId() << 32)
            yield from t.append_column("bundle", pa.array(bundle, pa.int64())).combine_chunks().to_batches()

    return groups.mapInArrow(run, "grp binary, bytes long, bundle long")


def pack_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard`` and gapless ``slot`` of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col(key).alias(key),
            (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("grp"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    grain = max(1, total // (shards * GRAIN))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    large = [(bytes(r.grp), r.bytes) for r in groups.where(F.col("bytes") >= grain).orderBy(F.desc("bytes"), "grp").collect()]
    small = stored(_bundles(groups.where(F.col("bytes") < grain), grain), "shard-bundles")
    bundles = [(r.bundle, r.bytes) for r in small.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "bundle").collect()]
    placed = pack(np.array([b for _, b in large + bundles], np.int64), shards).tolist() if large or bundles else []
    of_large = F.broadcast(spark.createDataFrame([(g, s) for (g, _), s in zip(large, placed)], "grp binary, shard int"))
    of_bundle = F.broadcast(spark.createDataFrame([(b, s) for (b, _), s in zip(bundles, placed[len(large) :])], "bundle long, shard int"))
    kept = [key, "size", "text_crc32", "shard"]
    put = stored(
        rows.join(of_large, "grp").select(kept).unionByName(
            rows.join(of_large.select("grp"), "grp", "left_anti").join(small.join(of_bundle, "bundle").select("grp", "shard"), "grp").select(kept)
        ),
        "shard-put",
    )
    put = put.withColumn("slice", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(SLICES)).cast("int"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = put.groupBy("shard", "slice").count()
    offsets = F.broadcast(counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    nth = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(key, "text_crc32", "size"))
    return put.withColumn("nth", nth).join(offsets, ["shard", "slice"]).select(
        key, "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot")
    )
