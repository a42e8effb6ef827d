"""Edges of the k-mer graph from buckets of k-mers: few narrow shuffles, no row for a k-mer's step.

An edge of one step joins two k-mers that aren't linear. Both of them name it, as a word of k + 1 bases, and it is an edge if both did (or
if it is its own reverse complement): names go to ranges of words, two numbers each, and are numbered there. Linear k-mers go to the
bucket of their minimizer, where those that follow each other become pieces at once; only pieces whose ends meet other
pieces are chained by pointer doubling. Everything else about an edge follows from its spelling.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.blocks import block_of, bucket_of, by_bucket, columns, dealt, reverse
from seqloom.operators.components import cut, dropped, recut
from seqloom.operators.rank import numbered

#: Ranges of words; words of a block of the result; the letters that ranges are made of.
LETTERS, PART = 6, 1 << 16
#: Bits of the buckets of reads and of k-mers that edges meet at.
END_BITS = 10
_LINKS = [f"{s}{b}" for s in "lr" for b in range(4)]
_FLIP = bytes.maketrans(b"ACTG", b"TGAC")
_DIGIT = bytes.maketrans(b"ACTG", b"0123")
EDGE = "edge_id long, src long, first long, last long, dst long, len int, cvg10 long, seq string, is_palindrome boolean"
_BLOCK = "bucket int, kind byte, block binary"


def alphabetical(word: np.ndarray) -> np.ndarray:
    """Packed words in the order of letters instead of canonical order, and back."""
    return word ^ ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))


def reverse_word(word: np.ndarray, n: int) -> np.ndarray:
    return reverse(word.view(np.int64), n).view(np.uint64)


def spelled(word: np.ndarray, n: int) -> np.ndarray:
    """Letters of packed words, a row of bytes each."""
    at = np.uint64(2) * np.arange(n - 1, -1, -1, dtype=np.uint64)
    return np.frombuffer(b"ACTG", np.uint8)[((word[:, None] >> at) & np.uint64(3)).astype(np.uint8)]


def node(word: np.ndarray, k: int) -> np.ndarray:
    """Numbers of oriented k-mers: 2 * km, plus 1 against the canonical direction."""
    back = reverse_word(word, k)
    return (np.minimum(word, back) << np.uint64(1) | (word > back).astype(np.uint64)).view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Few mixed bits of numbers."""
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - END_BITS)).astype(np.int64)


def _wide(n: int) -> type:
    return np.uint32 if n <= 16 else np.uint64


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """km, cnt and the eight link counts of a batch of the k-mer table."""
    return b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), np.stack([b.column(2 + n).to_numpy() for n in range(8)])


def _linear(links: np.ndarray) -> np.ndarray:
    return ((links[:4] > 0).sum(0) == 1) & ((links[4:] > 0).sum(0) == 1)


def half_edges(km: np.ndarray, cnt: np.ndarray, links: np.ndarray, k: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, n): the steps out of k-mers as canonical words of k + 1 bases, in the order of letters; n is the first k-mer's count in that direction, else 0."""
    words, counts = [], []
    for side in range(2):
        for base in range(4):
            at = np.flatnonzero(links[4 * side + base] > 0)
            one = km[at]
            if side:
                word = one << np.uint64(2) | np.uint64(base)
            else:
                word = reverse_word(np.uint64(base << 2 * k) | one, k + 1)
            back = reverse_word(word, k + 1)
            words.append(np.minimum(word, back))
            counts.append(np.where(word <= back, np.minimum(cnt[at], cap), 0))
    return alphabetical(np.concatenate(words)), np.concatenate(counts).astype(np.uint16)


def _short(kmers: DataFrame, k: int, cap: int) -> DataFrame:
    """(bucket, part, n, block): edges of one step in the order of their spelling, words and coverage of some in a block."""
    wide, shift, top = _wide(k + 1), np.uint64(2 * (k + 1 - LETTERS)), -(-cap // 10)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for b in batches:
                km, cnt, links = _rows(b)
                ends = ~_linear(links)
                word, n = half_edges(km[ends], cnt[ends], links[:, ends], k, top)
                yield (word >> shift).astype(np.int32), word.astype(wide), n

        yield from dealt(found())

    def work(chunks: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        word, n = columns([x for _, some in chunks for x in some], wide, np.uint16)
        order = np.argsort(word, kind="stable")
        word, n = word[order].astype(np.uint64), n[order]
        first = np.flatnonzero(np.diff(word, prepend=word[:1] ^ np.uint64(1)))
        times, n, word = np.diff(np.append(first, len(word))), np.maximum.reduceat(n, first), word[first]
        plain = alphabetical(word)
        keep = (times == 2) | (plain == reverse_word(plain, k + 1))
        word, n = word[keep], np.minimum(n[keep].astype(np.int32) * 10, cap).astype(np.uint16)
        bucket = (word[:1] >> shift).astype(np.int32).tolist()
        for part, at in enumerate(range(0, len(word), PART)):
            some = word[at : at + PART]
            data = block_of(some.astype(wide), n[at : at + PART])
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([part], pa.int32()), pa.array([len(some)], pa.int64()), pa.array([data], pa.binary())], ["bucket", "part", "n", "block"])

    narrow = kmers.select("km", "cnt", *_LINKS)
    return by_bucket(narrow.mapInArrow(give, _BLOCK), "bucket int, part int, n long, block binary", work)


def _pieces(kmers: DataFrame, k: int) -> DataFrame:
    """(seq, cov, head, tail, pred, to): linear k-mers of a bucket that follow each other, in one direction, with the bases of the steps into and out of them.

    ``head`` and ``tail`` are the first and last node, ``pred`` and ``to`` those around them, ``cov`` adds up left links.
    """
    mask, one = np.uint64((1 << 2 * k) - 1), np.uint64(1)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for b in batches:
                km, _, links = _rows(b)
                at = _linear(links)
                km, links = km[at], links[:, at]
                yield bucket_of(km.view(np.int64), k), km, (links[:4].argmax(0) | links[4:].argmax(0) << 2).astype(np.uint8), links[:4].max(0).astype(np.uint16)

        yield from dealt(found())

    def work(chunks: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        km, sides, own = columns([x for _, some in chunks for x in some], np.uint64, np.uint8, np.uint16)
        order = np.argsort(km)
        km, sides, own = km[order], sides[order], own[order].astype(np.int64)
        n = len(km)
        before, after = (sides & 3).astype(np.uint64), (sides >> 2).astype(np.uint64)
        # Node 2i is k-mer i as it is, 2i + 1 its reverse complement; leaving that goes over the left link.
        right = (km << np.uint64(2)) & mask | after
        left = reverse_word(km >> np.uint64(2) | before << np.uint64(2 * (k - 1)), k)
        word = np.stack((right, left), 1).ravel()
        back = reverse_word(word, k)
        to = np.minimum(word, back)
        turned = word > back
        at = np.minimum(np.searchsorted(km, to), n - 1)
        nxt = np.where(km[at] == to, 2 * at + turned, -1)
        me = np.arange(2 * n)
        ptr, far = np.where(nxt < 0, me, nxt), (nxt >= 0).astype(np.int64)
        for _ in range((2 * n).bit_length() + 1):
            more = far[ptr]
            if not more.any():
                break
            far, ptr = far + more, ptr[ptr]
        ends = nxt[ptr] < 0  # else on a circle
        head = np.flatnonzero((nxt[me ^ 1] < 0) & ends)
        head = head[head <= (ptr[head] ^ 1)]  # the other direction begins at the tail's other direction
        if not len(head):
            return
        size = far[head] + 1
        # All nodes of the pieces in order: sorted by tail and how far off that is.
        mine = np.zeros(2 * n, bool)
        mine[ptr[head]] = True
        some = np.flatnonzero(mine[ptr] & ends)
        some = some[np.lexsort((-far[some], ptr[some]))]
        head = head[np.argsort(ptr[head])]
        size = far[head] + 1
        cuts = np.cumsum(size) - size
        cov = np.add.reduceat(own[some >> 1], cuts)
        letter = np.frombuffer(b"ACTG", np.uint8)[(word[some] & np.uint64(3)).astype(np.uint8)]
        letters = letter.tobytes()
        tail = ptr[head]
        number = lambda x: (km[x >> 1] << one | (x & 1).astype(np.uint64)).view(np.int64)
        numbers = (to << one | turned.astype(np.uint64)).view(np.int64)
        whole = np.where(head & 1, reverse_word(km[head >> 1], k), km[head >> 1])
        pre = np.where(head & 1, after[head >> 1] ^ np.uint64(2), before[head >> 1])
        begin = spelled(pre << np.uint64(2 * k) | whole, k + 1).tobytes()
        seqs = [begin[(k + 1) * i : (k + 1) * (i + 1)] + letters[a : a + z] for i, (a, z) in enumerate(zip(cuts.tolist(), size.tolist()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seqs, pa.binary()).cast(pa.string()), pa.array(cov), pa.array(number(head)), pa.array(number(tail)), pa.array(numbers[head ^ 1] ^ 1), pa.array(numbers[tail])],
            ["seq", "cov", "head", "tail", "pred", "to"],
        )

    narrow = kmers.select("km", "cnt", *_LINKS)
    return by_bucket(narrow.mapInArrow(give, _BLOCK), "seq string, cov long, head long, tail long, pred long, to long", work, together=True)


def _chained(pieces: DataFrame, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """(seq, cov): pieces from a k-mer that isn't linear to the next, those that meet put together; circles go. Also the tables that they are made of."""
    one = F.lit(1).cast("long")
    ways = pieces.select(F.col("head").alias("u"), "to").unionByName(pieces.select(F.col("tail").bitwiseXOR(one).alias("u"), F.col("pred").bitwiseXOR(one).alias("to"))).distinct()
    heads = ways.select(F.col("u").alias("to"))
    met = cut(ways.join(heads, "to", "left_semi").select("u", "to"))
    parts = cut(met.select("u").unionByName(met.select(F.col("to").alias("u"))).distinct())
    state = parts.join(met, "u", "left").select("u", F.coalesce("to", "u").alias("tail"), F.col("to").isNotNull().cast("int").alias("far"), F.col("to").isNull().alias("done"))
    state = cut(state)
    for _ in range(parts.count().bit_length() + 1):  # what is open after that is a circle
        if state.where("not done").isEmpty():
            break
        nxt = state.select(F.col("u").alias("tail"), F.col("tail").alias("tail2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(nxt, "tail").where("tail2 <> u")  # back at the start
        moved = moved.select("u", F.col("tail2").alias("tail"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        state = recut(state.where("done").unionByName(moved), state)
    # A piece is in a chain in one direction or in both; a piece's two directions have chains of their own.
    twins = parts.withColumn("in", F.lit(True))
    alone = pieces.join(twins.select(F.col("u").alias("head"), F.col("in").alias("i1")), "head", "left").withColumn("t", F.col("tail").bitwiseXOR(one))
    alone = alone.join(twins.select(F.col("u").alias("t"), F.col("in").alias("i2")), "t", "left")
    whole = alone.where("i1 is null and i2 is null").select("seq", "cov")
    back = F.reverse(F.translate("seq", "ACTG", "TGAC"))
    open_ = cut(alone.where("i1 or i2").select("head", "t", "seq", "cov"))
    both = open_.select(F.col("head").alias("u"), "seq", "cov").unionByName(open_.where("t <> head").select(F.col("t").alias("u"), back.alias("seq"), "cov"))
    members = state.where("done").join(both, "u")
    rows = members.groupBy("tail").agg(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("at"), "seq"))).alias("m"), F.sum("cov").alias("cov"))  # an edge is one value in the result, too
    rest = F.array_join(F.transform(F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0))), lambda x: F.substring(x["seq"], k + 2, 1 << 30)), "")
    return whole.unionByName(rows.select(F.concat(F.col("m")[0]["seq"], rest).alias("seq"), "cov")), [met, parts, state, open_]


def _canonical(chains: DataFrame) -> DataFrame:
    """(seq, cov, is_palindrome): each chain in the direction that is canonical."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, same = [], []
            for s in b.column(0).cast(pa.binary()).to_pylist():
                r = s.translate(_FLIP)[::-1]
                out.append(s if s.translate(_DIGIT) <= r.translate(_DIGIT) else r)
                same.append(s == r)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), b.column(1), pa.array(same, pa.bool_())], ["seq", "cov", "is_palindrome"])

    return chains.select("seq", "cov").mapInArrow(run, "seq string, cov long, is_palindrome boolean")


class Edges:
    """The edges of a k-mer table, numbered by length and spelling: ``short`` ones of one step in blocks, ``long`` ones as rows."""

    def __init__(self, kmers: DataFrame, k: int, cap: int = 16_000):
        self.k, self.kmers = k, kmers
        self.short = cut(_short(kmers, k, cap))
        sizes = sorted(tuple(r) for r in self.short.select("bucket", "part", "n").collect())  # one row a block
        self.first, at = {}, 1
        for bucket, part, n in sizes:
            self.first[bucket, part] = at
            at += n
        self.numbers = np.uint32 if at < 1 << 32 else np.int64  # of edges of one step
        pieces = cut(_pieces(kmers, k))
        chains, made = _chained(pieces, k)
        chains = _canonical(chains).distinct()
        cvg = F.least(F.lit(cap), F.expr(f"cov div (length(seq) - {k} - 1)") * 10).cast("long")
        rows = chains.select((F.length("seq") - k).alias("len"), cvg.alias("cvg10"), "seq", "is_palindrome")
        rows = numbered(rows, ["len", "seq"], "edge_id", at)
        self.long = recut(rows, rows)
        for table in (pieces, *made):
            dropped(table)

    def _expanded(self) -> DataFrame:
        k, first, wide = self.k, self.first, _wide(self.k + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket, part, block in zip(*(c.to_pylist() for c in b.columns)):
                    word, cvg = columns([block], wide, np.uint16)
                    word = alphabetical(word.astype(np.uint64))
                    n = len(word)
                    begin = node(word >> np.uint64(2), k)
                    end = node(word & np.uint64((1 << 2 * k) - 1), k)
                    seq = pa.FixedSizeBinaryArray.from_buffers(pa.binary(k + 1), n, [None, pa.py_buffer(spelled(word, k + 1).tobytes())]).cast(pa.binary()).cast(pa.string())
                    same = word == reverse_word(word, k + 1)
                    at = np.arange(n, dtype=np.int64) + first[bucket, part]
                    yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in (at, begin, end, begin, end, np.ones(n, np.int32), cvg.astype(np.int64), seq, same)], EDGE_NAMES)

        return self.short.select("bucket", "part", "block").mapInArrow(run, EDGE)

    def _spelled_out(self) -> DataFrame:
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ends = nodes_of(b.column(3).cast(pa.binary()).to_pylist(), k)
                rows = [b.column(0), *map(pa.array, ends), b.column(1).cast(pa.int32()), b.column(2), b.column(3), b.column(4)]
                yield pa.RecordBatch.from_arrays(rows, EDGE_NAMES)

        return self.long.select("edge_id", "len", "cvg10", "seq", "is_palindrome").mapInArrow(run, EDGE)

    def rows(self) -> DataFrame:
        """(edge_id, src, first, last, dst, len, cvg10, seq, is_palindrome)."""
        return self._expanded().unionByName(self._spelled_out())

    def words(self) -> DataFrame:
        """Blocks of the words and numbers of edges of one step, by the bucket of their first k-mer."""
        k, first, wide, ids = self.k, self.first, _wide(self.k + 1), self.numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple]:
                for b in batches:
                    for bucket, part, block in zip(*(c.to_pylist() for c in b.columns)):
                        word = alphabetical(columns([block], wide, np.uint16)[0].astype(np.uint64))
                        src = word >> np.uint64(2)
                        src = np.minimum(src, reverse_word(src, k)).view(np.int64)
                        yield bucket_of(src, k), word.astype(wide), (np.arange(len(word), dtype=np.int64) + first[bucket, part]).astype(ids)

            yield from dealt(found())

        return self.short.select("bucket", "part", "block").mapInArrow(run, _BLOCK)

    def _ends(self) -> DataFrame:
        """Blocks (node, far, edge_id, cvg10, len) of the nodes that edges leave, in either direction, and the nodes that they would leave the other way."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple]:
                for b in batches:
                    at, src, dst, size, cvg = (c.to_numpy() for c in b.columns)
                    far, cvg, size = dst ^ 1, cvg.astype(np.int32), size.astype(np.int32)
                    yield mixed(src >> 1).astype(np.int32), src, far, at, cvg, size
                    two = far != src  # a palindrome leaves one node
                    yield mixed(far[two] >> 1).astype(np.int32), far[two], src[two], at[two], cvg[two], size[two]

            yield from dealt(found(), 1)

        return self.rows().select("edge_id", "src", "dst", "len", "cvg10").mapInArrow(run, _BLOCK)

    def tips(self, longest: int) -> DataFrame:
        """(edge_id): edges of up to ``longest`` that begin or end at a node of no other edge, and that have a sibling of more coverage at their other end."""
        kinds = np.int64, np.int64, np.int64, np.int32, np.int32

        def dead(chunks: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
            """Short edges out of nodes that none enters."""
            own, far, at, cvg, size = columns([x for _, some in chunks for x in some], *kinds)
            some = (size <= longest) & ~np.isin(own ^ 1, own)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (far[some], at[some], cvg[some])], ["node", "edge_id", "cvg10"])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ([c.to_numpy() for c in b.columns] for b in batches)
            yield from dealt(((mixed(own >> 1).astype(np.int32), own, at, cvg) for own, at, cvg in rows), 0)

        def weaker(chunks: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, list[bytes]] = {0: [], 1: []}
            for kind, some in chunks:
                blocks[kind] += some
            if blocks[0]:
                node, at, cvg = columns(blocks[0], np.int64, np.int64, np.int32)
                own, _, _, most, _ = columns(blocks[1], *kinds)
                order = np.lexsort((most, own))
                own, most = own[order], most[order]
                tip = at[cvg < most[np.searchsorted(own, node, "right") - 1]]  # the edge itself leaves there, too
                yield pa.RecordBatch.from_arrays([pa.array(tip)], ["edge_id"])

        ends = self._ends()
        found = cut(by_bucket(ends, "node long, edge_id long, cvg10 int", dead))
        return by_bucket(found.mapInArrow(ask, _BLOCK).unionByName(ends), "edge_id long", weaker).distinct()


EDGE_NAMES = [x.split()[0] for x in EDGE.split(", ")]


def packed_words(words: Iterable[bytes], n: int) -> np.ndarray:
    """Packed numbers of words of n letters each."""
    data = np.frombuffer(b"".join(words).translate(bytes.maketrans(b"ACTG", bytes(range(4)))), np.uint8).reshape(-1, n)
    out = np.zeros(len(data), np.uint64)
    for j in range(n):
        out = out << np.uint64(2) | data[:, j].astype(np.uint64)
    return out


def nodes_of(seqs: list[bytes], k: int) -> list[np.ndarray]:
    """src, first, last and dst of edges' spellings."""
    sides = ([s[:k] for s in seqs], [s[1 : k + 1] for s in seqs], [s[-k - 1 : -1] for s in seqs], [s[-k:] for s in seqs])
    return [node(packed_words(x, k), k) for x in sides]
