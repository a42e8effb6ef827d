"""Operator 9: embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its
hash is the axis (and sign) of its largest component. A table's bucket is ``HASHES`` such
axes; each vector enters, besides its own bucket, the next likeliest ones (``PROBES`` in all:
the runner-up axes with the least loss), so that near vectors meet in one of ``TABLES``
tables. Pairs that meet are verified by their cosine in double precision; only pairs
of equal labels meet. A pair is verified in the first table and bucket that both share.

Equal vectors of one label are one node with a count, so groups of copies need no pairs.
Buckets with more than ``BLOCK`` vectors are cut into blocks and every pair of blocks is
a task of its own: nothing is dropped, and no task holds more than two blocks. Pairs stay
inside their task, which gives each vector's number of links there and links to the least
vector that its pairs connect it with; no pair is written out.

Vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label, link with nothing: 0 links, a component of their own. Vectors of
different lengths never link. Repeated rows count as vectors of their own. Rows without an
id count as links of others but name no component (null if all of it has none) and aren't kept; rows that share an id but not
their vector are vectors of their own, each with its own links. An empty table
gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.chunks import parts
from seqloom.llm.common import slices, stored
from seqloom.operators.components import connected_components

TABLES, HASHES, PROBES = 8, 2, 4
ROUNDS = 3
SEED = 9
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; its length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray) -> np.ndarray:
    """TABLES * PROBES bucket numbers of each row, the table among them."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, width]).choice((-1.0, 1.0), (TABLES, HASHES, ROUNDS, width))
    out = np.empty((len(x), TABLES, PROBES), np.int64)
    r = np.arange(len(x))
    for t in range(TABLES):
        code, loss = [], []
        for h in range(HASHES):
            y = padded
            for k in range(ROUNDS):
                y = hadamard(y * signs[t, h, k])
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :PROBES]
            code.append(2 * best + (y[r[:, None], best] < 0))
            loss.append(size[r, best[:, 0]][:, None] - size[r[:, None], best])
        # The likeliest combinations of axes: least total loss.
        total, bucket = loss[0], code[0]
        for a, b in zip(loss[1:], code[1:]):
            total = (total[:, :, None] + a[:, None, :]).reshape(len(x), -1)
            bucket = (bucket[:, :, None] * (2 * width) + b[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(total, axis=1, kind="stable")[:, :PROBES]
            total, bucket = total[r[:, None], keep], bucket[r[:, None], keep]
        out[:, t] = bucket * TABLES + t
    return out.reshape(len(x), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def nodes(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors (label, v, node, copies, least), and (key, node) of every row, node null where unusable.

    ``node`` is a number of its own for each distinct vector, ``least`` the least key of its rows: keys may repeat or be null.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("id"), F.when(usable, F.col(label)).alias("label"), F.when(usable, v).alias("v"))
    # -0.0 is 0.0 as a number, not as a group.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("hash", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    rows = stored(rows, "vectors")
    groups = rows.where("v is not null").groupBy("label", "hash").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    groups = stored(groups.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    members = rows.select("id", "label", "hash").join(groups.select("label", "hash", "node"), ["label", "hash"], "left").select("id", "node")
    return groups, members


def near_links(groups: DataFrame, least: float) -> DataFrame:
    """(node, linked, to) rows of nodes of one label and pairs whose cosine is at least ``least``.

    ``linked`` adds up to the rows that a node's pairs stand for; ``to`` connects all that pairs connect.
    """
    width = F.size("v")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            lengths = np.diff(b.column(1).offsets.to_numpy())
            for n in np.unique(lengths):
                part = b.filter(pa.array(lengths == n))
                x = _matrix(part.column(1))
                found = pa.array(buckets(x).ravel())
                ends = pa.array(np.arange(0, len(x) * TABLES * PROBES + 1, TABLES * PROBES), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, found)], ["node", "buckets"])

    marked = groups.select("node", "v").mapInArrow(hashed, "node long, buckets array<long>")
    kept = stored(groups.select("node", "label", "copies", "v", width.alias("width")).join(marked, "node"), "vector-buckets")
    entries = kept.select("node", "label", "width", F.explode("buckets").alias("bucket")).distinct()
    place = ["label", "width", "bucket"]
    full = entries.groupBy(place).count().where("count > 1")
    entries = entries.join(full, place)
    # Members of a bucket in blocks; each member goes to all pairs of blocks that its own is in.
    nth = F.row_number().over(Window.partitionBy(place).orderBy("node")) - 1
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    entries = entries.withColumn("blocks", blocks).withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.floor(nth / BLOCK).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = entries.select("node", *place, "block", other.alias("other"))
    spread = spread.select("node", *place, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    task = [*place, "lo", "hi"]
    dealt = spread.join(kept.select("node", "copies", "v", "buckets"), "node").repartition(*task).sortWithinPartitions(*task, "node")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            node, block, copies = (t[c].to_numpy() for c in ("node", "block", "copies"))
            x = _matrix(t["v"].chunk(0))
            x /= np.sqrt((x * x).sum(1))[:, None]
            all_buckets = t["buckets"].chunk(0).flatten().to_numpy().reshape(len(x), -1)
            keys = np.stack([t[c].fill_null(-1).to_numpy().astype(np.int64) for c in task], 1)
            edge = np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))
            starts = np.flatnonzero(edge)
            found = []
            for s, e in zip(starts, np.append(starts[1:], len(x))):
                if e - s < 2:
                    continue
                i, j = np.nonzero(np.triu(x[s:e] @ x[s:e].T >= least - 1e-9, 1))
                i, j = i + s, j + s
                one = keys[s, 3] == keys[s, 4]
                if not one:  # pairs within a block are that block's own task
                    apart = block[i] != block[j]
                    i, j = i[apart], j[apart]
                if not len(i):
                    continue
                cos = np.einsum("ij,ij->i", x[i], x[j])
                i, j = i[cos >= least], j[cos >= least]
                shared = (all_buckets[i][:, :, None] == all_buckets[j][:, None, :]).any(2)
                first = np.take_along_axis(all_buckets[i], shared.argmax(1)[:, None], 1)[:, 0] if len(i) else np.empty(0, np.int64)
                mine = first == keys[s, 2]
                found.append((i[mine], j[mine]))
            i, j = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            linked = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            ids, row = np.unique(node, return_inverse=True)  # a node may be in several of the tasks
            linked, to = np.bincount(row, linked), parts(len(ids), row[i], row[j])
            some = np.flatnonzero(linked)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(linked[some].astype(np.int64)), pa.array(ids[to[some]])], ["node", "linked", "to"])

        for batch in batches:  # a task's rows may run on into the next batch
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held[c][-1].as_py() for c in task]
            n = held.num_rows
            while n and [held[c][n - 1].as_py() for c in task] == last:
                n -= 1
            if n:
                yield pairs(held.slice(0, n))
                held = held.slice(n)
        if held is not None and held.num_rows:
            yield pairs(held)

    columns = ["node", "copies", *place, "block", "lo", "hi", "v", "buckets"]
    return dealt.select(columns).mapInArrow(verified, "node long, linked long, to long")


def near_vectors(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    groups, members = nodes(vectors, key, vector, label)
    found = stored(near_links(groups, least), "vector-links")
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    reached = connected_components(found, "node", "to")
    known = groups.select("node", "copies", "least").join(linked, "node", "left").join(reached, "node", "left").select(
        "node",
        "least",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    # A component is named by the least key of all its rows.
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(names, "component").select("node", "n_links", "component_id")
    own = F.coalesce("component_id", "id")
    return members.join(known, "node", "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(own == F.col("id"), F.lit(False)).alias("kept"),
    )
