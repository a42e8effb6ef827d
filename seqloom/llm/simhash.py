"""Operator 8: SimHash near-duplicates by meet-in-the-middle ball hashing.

The fingerprint of a text has a bit for each of 64 places that is set in over half of
its word shingles' XXH64 hashes. Two fingerprints link at ``RADIUS`` = 3 or fewer
differing bits; documents that share a fingerprint are one node.

Ball hashing. A fingerprint emits the variants within half the radius and is shuffled on
them, so that linked fingerprints meet on a variant between them. It runs on halves first:
fingerprints at distance 3 or less differ in at most one bit in one 32-bit half. As a
single bit changes a half's parity, even halves emit themselves, odd ones themselves and
their 32 one-bit variants. Fingerprints that meet are compared in buckets of up to
``BUCKET``, and enough links kept to connect all that are linked there. Those in larger buckets (a group of very many near copies) emit variants of
all 64 bits, where no pairs are needed:

* odd fingerprints emit their 64 one-bit variants;
* even ones emit themselves, their one-bit variants, and the two-bit variants whose
  bits lie in the same half.

Distance 1: the odd one's variant is the even one. Distance 2, both odd, or both even
with bits in different halves: one bit from each; both even in one half: one is the
other's two-bit variant. Distance 3: two of the three bits share a half, the even
one flips these, the odd one the third. On a variant, any member at most one bit away
is within three bits of every member, so linking all to one such member loses no
connection; a variant where all are two away links nothing. A ball holds at most 2,081
fingerprints, however many documents there are.

Definitions for odd input: null and blank texts have no words and fingerprint zero,
which links as any other does. Fewer words than a shingle: the whole sequence is the
one shingle. Repeated rows and ties need nothing special: equal fingerprints are
equal nodes and the least id names the component. Rows with a null id get a
fingerprint but name no component of their own unless alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_text, stored
from seqloom.operators.components import connected_components

RADIUS = 3
BITS = 64
HALF = 32
SEED = 42
#: Fingerprints in a bucket that are compared with each other; more are met in the whole ball.
BUCKET = 4096
#: Shingles hashed and counted at a time, so that a very long text needs bounded memory.
PART = 1 << 16

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)


def simhash(text: bytes, width: int) -> int:
    """The fingerprint of one text."""
    found = text.translate(_FOLD).split()
    if not found:
        return 0
    line = b" ".join(found)
    h = xxhash.xxh64_intdigest
    if len(found) <= width:
        return h(line, SEED)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(found) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), PART):
        hashes = np.array([h(line[a:z], SEED) for a, z in zip(starts[at : at + PART], ends[at : at + PART])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: list[str], text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """``key`` columns and the fingerprint as a signed 64-bit integer."""

    def make():
        def run(texts: list[bytes]) -> list:
            return [pa.array(np.fromiter((simhash(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))]

        return run

    return map_text(docs, key, text, f"{out} long", make, "bytes")


def _emitted(df: DataFrame, make, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            view, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for v in np.unique(view):
                own = fps[view == v]
                for at in range(0, len(own), 256):
                    out = make(own[at : at + 256])
                    yield out.add_column(0, "view", pa.array(np.full(out.num_rows, v), pa.int8()))

    return df.select("view", "fp").mapInArrow(run, f"view byte, {schema}")


def _halves(fps: np.ndarray) -> pa.RecordBatch:
    """(which half and variant, fingerprint) rows of the first pass."""
    rows = []
    flips = np.uint64(1) << np.arange(HALF, dtype=np.uint64)
    for side in (0, 1):
        half = (fps >> np.uint64(HALF * side)) & np.uint64(0xFFFFFFFF)
        odd = np.bitwise_count(half) % 2 == 1
        near = (half[odd, None] ^ flips).ravel()
        rows.append((side, np.concatenate((half, near)), np.concatenate((fps, np.repeat(fps[odd], HALF)))))
    variant = np.concatenate([v | np.uint64(s << 40) for s, v, _ in rows]).astype(np.int64)
    return pa.RecordBatch.from_pydict({"variant": variant, "fp": np.concatenate([f for *_, f in rows]).view(np.int64)})


def _met(batches):
    """Of rows sorted by view and variant: links between fingerprints that share one.

    Up to ``BUCKET`` fingerprints are compared here, and links that connect what was not connected
    come out: about one a fingerprint. Those of larger buckets come out alone, to be met in the whole ball.
    """
    held, large = np.empty((3, 0), np.int64), None  # the last bucket so far, or its key once it is large

    def found(rows: np.ndarray):
        key = np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))) if rows.shape[1] else np.empty(0, bool)
        bucket = np.cumsum(key) - 1
        sizes = np.bincount(bucket)
        big = sizes[bucket] > BUCKET
        yield rows[0, big], rows[2, big], None
        rows, bucket = rows[:, ~big], bucket[~big]
        fp = rows[2].view(np.uint64)
        part = np.arange(len(fp))  # the least row known to be connected; links inside a part are left out
        for d in range(1, min(BUCKET, len(fp))):
            i = np.flatnonzero(bucket[d:] == bucket[:-d])
            if not len(i):
                break
            i = i[part[i] != part[i + d]]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
            if len(i):
                yield rows[0, i], rows[2, i], rows[2, i + d]
                while (part[i] != part[i + d]).any():
                    low = np.minimum(part[i], part[i + d])
                    np.minimum.at(part, part[i], low)
                    np.minimum.at(part, part[i + d], low)
                    while (part != part[part]).any():
                        part = part[part]

    def out(parts):
        for view, x, y in parts:
            if len(x):
                t = pa.Table.from_arrays([pa.array(view, pa.int8()), pa.array(x), pa.nulls(len(x), pa.int64()) if y is None else pa.array(y)], ["view", "a", "b"])
                yield from t.group_by(["view", "a", "b"]).aggregate([]).select(["view", "a", "b"]).to_batches()

    for b in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
        if large is not None:
            on = (rows[0] == large[0]) & (rows[1] == large[1])
            yield from out([(rows[0, on], rows[2, on], None)])
            rows = rows[:, ~on]
            if not rows.shape[1]:
                continue
            large = None
        rows = np.concatenate((held, rows), 1)
        if not rows.shape[1]:
            continue
        last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
        yield from out(found(rows[:, ~last]))
        held = rows[:, last]
        if held.shape[1] > BUCKET:
            large = held[:2, 0].tolist()
            yield from out([(held[0], held[2], None)])
            held = held[:, :0]
    yield from out(found(held))


def _ball(fps: np.ndarray) -> pa.RecordBatch:
    """(variant, flipped bits, fingerprint) rows."""
    ones = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    i, j = np.triu_indices(HALF, 1)
    twos = np.concatenate([ones[i + s] | ones[j + s] for s in (0, HALF)])
    even = fps[np.bitwise_count(fps) % 2 == 0]
    parts = [(0, even, np.zeros(1, np.uint64)), (1, fps, ones), (2, even, twos)]
    return pa.RecordBatch.from_pydict(
        {
            "variant": np.concatenate([(f[:, None] ^ x).ravel() for _, f, x in parts]).view(np.int64),
            "bits": np.concatenate([np.full(len(f) * len(x), n, np.int8) for n, f, x in parts]),
            "fp": np.concatenate([np.repeat(f, len(x)) for _, f, x in parts]).view(np.int64),
        }
    )


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``(view, a, b)`` between distinct fingerprints ``(view, fp)`` of a view within the radius.

    They connect all that are linked, without being all links.
    """
    halves = _emitted(fps, _halves, "variant long, fp long")
    halves = halves.repartition("view", "variant").sortWithinPartitions("view", "variant")
    met = stored(halves.mapInArrow(_met, "view byte, a long, b long"), "simhash-met")
    large = met.where("b is null").select("view", F.col("a").alias("fp")).distinct()
    balls = _emitted(large.repartition("view", "fp"), _ball, "variant long, bits byte, fp long")
    dense = (
        balls.groupBy("view", "variant")
        .agg(F.min(F.struct("bits", "fp")).alias("best"), F.collect_list("fp").alias("members"))  # at most 2,081
        .where("size(members) > 1 and best.bits <= 1")
        .select("view", F.col("best.fp").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return met.where("b is not null").unionByName(dense).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key``, ``fp`` and ``component_id``: the least key reachable over links of at most ``RADIUS`` bits."""
    marked = stored(fingerprints(docs, [key], text, width), "simhash-fp")
    classes = marked.groupBy("fp").agg(F.min(key).alias("least"))
    parts = connected_components(near_links(classes.select(F.lit(0).cast("byte").alias("view"), "fp")))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    least = named.where("component is not null").groupBy("part").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "part", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(ids, "fp", "left").select(key, "fp", F.coalesce("component_id", F.col(key)).alias("component_id"))
