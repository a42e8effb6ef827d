"""K-mers in blocks: windows that follow each other in a read travel together, two bits a base.

Each window's bucket comes from its minimizer, the least of its canonical words of ``word_size(k)`` bases in a mixed order,
which is the same on both strands. Neighbouring windows mostly share it, so a run of windows of one bucket is sent
as its bases: some 1.2 bytes a window of 23 bases instead of a row each. All occurrences of a k-mer are in one bucket, and a
task works on one bucket at a time, which it adds up as its blocks come in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of k-mers; windows of a run at most; bases of reads cut at a time; windows of a bucket worked on at a time; windows
#: up to which buckets are worked on together, and rows of a result batch.
BUCKETS, RUN, PIECE, CHUNK, SMALL = 4096, 255, 1 << 20, 1 << 20, 1 << 15
_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(b"ACTG", np.uint8)] = np.arange(4)
_FLIP = np.array([2, 3, 0, 1, 4], np.uint8)
_HEAD = 8


def codes(data: np.ndarray, k: int) -> np.ndarray:
    """Packed words of k bases from every place on, put together from words of 1, 2, 4, ... bases."""
    kind = np.int32 if k < 16 else np.int64
    n = len(data)
    word, size, out, done = data.astype(kind) & 3, 1, None, 0
    while True:
        if k & size:
            out = word if out is None else (out[: max(0, n - done - size + 1)] << 2 * size) | word[done:]
            done += size
        if done == k:
            return out
        word = (word[: max(0, n - 2 * size + 1)] << 2 * size) | word[size:]
        size *= 2


def reverse(code: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complements: halves of ever smaller groups of bases are swapped."""
    x = code.view(np.uint64) ^ np.uint64(0xAAAAAAAAAAAAAAAA)
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        m, by = np.uint64(mask), np.uint64(bits)
        x = ((x >> by) & m) | ((x & m) << by)
    return (x.byteswap() >> np.uint64(64 - 2 * k)).view(np.int64)


def word_size(k: int) -> int:
    return 9 if k >= 19 else 7


@cache
def _order(m: int) -> np.ndarray:
    """A mixed number of each word of m bases, the same on both strands."""
    word = np.arange(4**m, dtype=np.int64)
    x = np.minimum(word, reverse(word, m)).astype(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return (x & np.uint64(0x7FFFFFFF)).astype(np.int32)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` numbers from every place on."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def runs(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, bucket) of the runs of windows of coded bases, by bucket; 255 is no base."""
    n = len(data) - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    m = word_size(k)
    bad = np.concatenate(([0], np.cumsum(data > 3, dtype=np.int32)))
    at = _least(_order(m)[codes(data, m)], k - m + 1) % BUCKETS
    at[bad[k:] != bad[:-k]] = -1
    start = np.flatnonzero(np.diff(at, prepend=-2))
    size = np.diff(np.append(start, n))
    start, size, at = start[keep := at[start] >= 0], size[keep], at[start][keep]
    parts = -(-size // RUN)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, at, size = np.repeat(start, parts) + nth * RUN, np.repeat(at, parts), np.minimum(RUN, np.repeat(size, parts) - nth * RUN)
    order = np.argsort(at, kind="stable")
    return start[order], size[order], at[order]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, ``size`` numbers each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def packed(seqs: list[bytes], k: int, ids: np.ndarray | None = None) -> tuple[list[int], list[bytes]]:
    """Buckets and blocks of reads: numbers of windows and outer bases of the runs, their bases; with ``ids`` also each run's read and place in it."""
    data = _CODE[np.frombuffer(b"\n".join(seqs) + b"\n", np.uint8)]
    start, size, bucket = runs(data, k)
    if not len(start):
        return [], []
    padded = np.concatenate(([255], data, [255] * 5)).astype(np.uint8)
    sides = np.minimum(padded[start], 4) * 5 + np.minimum(padded[start + size + k], 4)
    width = (size + k + 2) // 4
    base = padded[_spread(start + 1, width * 4)].reshape(-1, 4) & 3
    bases = ((base[:, 0] << 6) | (base[:, 1] << 4) | (base[:, 2] << 2) | base[:, 3]).tobytes()
    sizes, sides = size.astype(np.uint8).tobytes(), sides.astype(np.uint8).tobytes()
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    last = np.append(first[1:], len(start))
    upto = np.concatenate(([0], np.cumsum(width)))
    windows = np.add.reduceat(size, first)
    whose = where = b""
    if ids is not None:
        lengths = np.fromiter(map(len, seqs), np.int64, len(seqs)) + 1
        begins = np.cumsum(lengths) - lengths
        read = np.searchsorted(begins, start, "right") - 1
        whose, where = ids[read].astype(np.int64).tobytes(), (start - begins[read]).astype(np.int32).tobytes()
    heads = np.stack((last - first, windows), 1).astype(np.int32).tobytes()
    blocks = [
        b"".join((heads[i * _HEAD : i * _HEAD + _HEAD], whose[a * 8 : z * 8], where[a * 4 : z * 4], sizes[a:z], sides[a:z], bases[b:c]))
        for i, (a, z, b, c) in enumerate(zip(first.tolist(), last.tolist(), upto[first].tolist(), upto[last].tolist()))
    ]
    return bucket[first].tolist(), blocks


class Windows:
    """Windows of blocks: ``km``, ``fwd``, ``left`` and ``right`` (4: none), with ids also ``read`` and ``place``."""

    def __init__(self, blocks: list[bytes], k: int, named: bool):
        parts: list[list[bytes]] = [[], [], [], [], []]
        for b in blocks:
            n, at = int.from_bytes(b[:4], "little"), _HEAD
            for part, width in zip(parts, (8 * named * n, 4 * named * n, n, n, len(b))):
                part.append(b[at : at + width])
                at += width
        whose, where, sizes, sides, bases = (np.frombuffer(b"".join(p), t) for p, t in zip(parts, (np.int64, np.int32, np.uint8, np.uint8, np.uint8)))
        size = sizes.astype(np.int64)
        width = (size + k + 2) // 4 * 4
        data = np.stack((bases >> 6, bases >> 4, bases >> 2, bases), 1).ravel() & 3
        begin = np.cumsum(width) - width
        at = _spread(begin, size)
        code = codes(data, k).astype(np.int64)[at]
        back = reverse(code, k)
        ends = np.cumsum(size)
        left = data[at - 1]
        left[ends - size] = sides // 5
        right = data[np.minimum(at + k, len(data) - 1)]
        right[ends - 1] = sides % 5
        self.word, self.before, self.after = code, left, right  # as the read has them
        self.fwd = code < back
        self.km = np.where(self.fwd, code, back)
        self.left, self.right = np.where(self.fwd, left, _FLIP[right]), np.where(self.fwd, right, _FLIP[left])
        if named:
            self.read, self.place = np.repeat(whose, size), _spread(where.astype(np.int64), size).astype(np.int32)


def blocks(reads: DataFrame, k: int, key: str | None = None, kind: int = 0) -> DataFrame:
    """(bucket, kind, block): the runs of all reads; with ``key`` they name their read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = b.column(0).cast(pa.binary()).to_pylist()
            ids = b.column(1).to_numpy(zero_copy_only=False) if key else None
            at = 0
            while at < len(seqs):
                n, z = 0, at
                while z < len(seqs) and (n := n + len(seqs[z] or b"")) < PIECE:
                    z += 1
                z = min(z + 1, len(seqs))
                found, data = packed([s or b"" for s in seqs[at:z]], k, ids[at:z] if key else None)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([kind] * len(found), pa.int8()), pa.array(data, pa.binary())], ["bucket", "kind", "block"])
                at = z

    if key:
        reads = reads.where(F.col(key).isNotNull())
    return reads.select("seq", *([F.col(key).cast("long")] if key else [])).mapInArrow(run, "bucket int, kind byte, block binary")


def bucket_of(word: np.ndarray, k: int) -> np.ndarray:
    """The buckets of k-mers' windows."""
    m = word_size(k)
    order = _order(m)
    least = order[word & (4**m - 1)]
    for j in range(1, k - m + 1):
        least = np.minimum(least, order[(word >> 2 * j) & (4**m - 1)])
    return least % BUCKETS


def asked(kmers: DataFrame, k: int, km: str = "km", kind: int = 1) -> DataFrame:
    """(bucket, kind, block): k-mers that are looked up in the bucket where all windows of theirs are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.array([0, 1], np.int32).tobytes()
        for b in batches:
            word = b.column(0).to_numpy()
            at = bucket_of(word, k)
            data = [head + w for w in np.ascontiguousarray(word).view("V8").tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([kind] * len(at), pa.int8()), pa.array(data, pa.binary())], ["bucket", "kind", "block"])

    return kmers.select(km).mapInArrow(run, "bucket int, kind byte, block binary")


def asked_for(blocks: list[bytes]) -> np.ndarray:
    """The k-mers in blocks of ``asked``."""
    return np.frombuffer(b"".join(b[_HEAD:] for b in blocks), np.int64)


def block_of(*rows: np.ndarray) -> bytes:
    """A block of columns of numbers: of each the lowest bytes of all, then the next ones, so that high bytes take hardly any place when it is compressed."""
    n = np.int32(len(rows[0])).tobytes()
    return b"".join((n, n, *(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in rows)))


def columns(blocks: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The columns of blocks of ``block_of``."""
    sizes = [int.from_bytes(b[:4], "little") for b in blocks]
    out = []
    at = [_HEAD] * len(blocks)
    for kind in map(np.dtype, kinds):
        w = kind.itemsize
        whole = np.empty((sum(sizes), w), np.uint8)
        done = 0
        for i, (b, n) in enumerate(zip(blocks, sizes)):
            whole[done : done + n] = np.frombuffer(b, np.uint8, n * w, at[i]).reshape(w, n).T
            at[i] += n * w
            done += n
        out.append(whole.view(kind).ravel())
    return out


def dealt(found: Iterable[tuple], kind: int = 0, reduce: Callable[..., tuple] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches (bucket, kind, block) of columns of numbers, (bucket, column, ...) each, of which a task gathers many; ``reduce`` may make fewer rows of them first."""

    def sent(held: list[tuple]) -> pa.RecordBatch:
        at, *rest = (np.concatenate(x) for x in zip(*held))
        if reduce:
            at, *rest = reduce(at, *rest)
        order = np.argsort(at, kind="stable")
        at, rest = at[order], [x[order] for x in rest]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        blocks = [block_of(*(x[a:z] for x in rest)) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(at)])]
        return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array([kind] * len(first), pa.int8()), pa.array(blocks, pa.binary())], ["bucket", "kind", "block"])

    held, n = [], 0
    for x in found:
        if len(x[0]):
            held.append(x)
            n += len(x[0])
        if n >= CHUNK:
            yield sent(held)
            held, n = [], 0
    if held:
        yield sent(held)
    pa.default_memory_pool().release_unused()


def by_bucket(
    parts: DataFrame, schema: str, work: Callable[[Iterator[tuple[int, list[bytes]]]], Iterator], together: bool = False, deal: Callable[[Iterator], Iterator[pa.RecordBatch]] | None = None
) -> DataFrame:
    """``work`` on each bucket's blocks, which come as (kind, some blocks) in the order of kinds; ``together``: small buckets of one kind in one go.

    ``deal`` makes batches of all that ``work`` gives in a task, as ``dealt`` does.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield from zip(*(c.to_pylist() for c in b.slice(at, 512).columns))

    def chunks(own: int, held: list) -> Iterator[tuple[int, list[bytes]]]:
        """The blocks of bucket ``own``; leaves the next bucket's first row in ``held``."""
        some, kind, n, all_ = [], None, 0, 0
        while held[0] is not None and (held[0][0] == own or together and all_ < SMALL):
            own, of, block = held[0]
            if some and (of != kind or n >= CHUNK):
                yield kind, some
                some, n = [], 0
            kind = of
            some.append(block)
            n += (size := int.from_bytes(block[4:8], "little"))
            all_ += size
            held[0] = next(held[1], None)
        if some:
            yield kind, some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = rows(batches)
        held, done = [next(source, None), source], []

        def found() -> Iterator:
            while held[0] is not None:
                yield from work(chunks(held[0][0], held))

        if deal:
            yield from deal(found())
        else:
            for b in found():
                done.append(b)
                if sum(b.num_rows for b in done) >= SMALL:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done.clear()
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        pa.default_memory_pool().release_unused()

    return parts.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)
