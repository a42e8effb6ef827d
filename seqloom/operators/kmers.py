"""The k-mer table: windows over reads, canonical counts and link counts, and its first cleaners.

A k-mer is held packed, two bits a base in one 64-bit integer (odd k up to 31), so
integer order is canonical order. Reads travel in ``blocks``: runs of windows, two bits a base, go to the
bucket of their k-mers, where windows are cut with numpy and added up. Neither texts nor windows are exploded into rows.

``kmers`` has km, cnt, and eight link counts l0..l3, r0..r3 (bases A, C, T, G to the left
and right), each at most 63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.blocks import Windows, asked, asked_for, blocks, by_bucket, reverse
from seqloom.operators.components import cut

CAP = 63
LEFT = [f"l{b}" for b in range(4)]
RIGHT = [f"r{b}" for b in range(4)]
LINKS = LEFT + RIGHT
#: Bases of reads cut at a time; k-mers of a result batch.
PIECE, ROWS = 1 << 18, 1 << 16
_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(b"ACTG", np.uint8)] = np.arange(4)


def odd(k: int) -> int:
    """k as used: even values go up by one; 13 to 31."""
    k += 1 - k % 2
    if not 13 <= k <= 31:
        raise ValueError("packed k-mers have 13 to 31 bases")
    return k


def rc_code(code: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complement: the complement of a base is its code XOR 2."""
    out = np.zeros_like(code)
    rest = code.copy()
    for _ in range(k):
        out = (out << 2) | ((rest & 3) ^ 2)
        rest >>= 2
    return out


def windows(seqs: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """All windows of all reads: (read number, place, canonical code, read as is, left base, right base); 4 is no base.

    Windows that touch a letter other than A, C, T, G are left out, and such a letter is no base.
    """
    data = _CODE[np.frombuffer(b"\n".join(seqs) + b"\n", np.uint8)]
    sizes = np.fromiter(map(len, seqs), np.int64, len(seqs)) + 1
    n = len(data) - k + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty.astype(bool), empty.astype(np.uint8), empty.astype(np.uint8)
    bad = np.concatenate(([0], np.cumsum(data > 3)))
    at = np.flatnonzero(bad[k:] == bad[:-k])
    code = np.zeros(len(at), np.int64)
    back = np.zeros(len(at), np.int64)
    for j in range(k):
        base = data[at + j].astype(np.int64)
        code = (code << 2) | base
        back |= (base ^ 2) << (2 * j)
    padded = np.concatenate(([255], data, [255]))
    left, right = np.minimum(padded[at], 4), np.minimum(padded[at + k + 1], 4)
    forward = code < back
    flip = np.array([2, 3, 0, 1, 4], np.uint8)
    read = np.repeat(np.arange(len(seqs)), sizes)[at]
    place = at - (np.cumsum(sizes) - sizes)[read]
    return read, place, np.where(forward, code, back), forward, np.where(forward, left, flip[right]), np.where(forward, right, flip[left])


def pieces(values: list, size: int = PIECE) -> Iterator[tuple[int, list]]:
    """Runs of values with about ``size`` letters, with the place each starts at."""
    start, n = 0, 0
    for i, v in enumerate(values):
        n += len(v)
        if n >= size:
            yield start, values[start : i + 1]
            start, n = i + 1, 0
    if start < len(values):
        yield start, values[start:]


def reads_of(docs: DataFrame, key: str = "doc_id", text: str = "text", lib: str = "source", k: int = 23) -> DataFrame:
    """(read_id, lib_id, seq): any text as a read; reads under k + 1 bases go."""
    from seqloom.functions.seq import bases

    return bases(docs.select(F.col(key).alias("read_id"), F.col(lib).alias("lib_id"), F.col(text).alias("seq")), "seq", least=k + 1)


def occurrences(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, j, km, fwd, l, r): every window of every read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, seqs = b.column(0), b.column(1).cast(pa.binary()).to_pylist()
            for start, part in pieces(seqs):
                read, place, km, forward, left, right = windows(part, k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(read + start)), pa.array(place.astype(np.int32)), pa.array(km), pa.array(forward), pa.array(left.astype(np.int8)), pa.array(right.astype(np.int8))],
                    ["read_id", "j", "km", "fwd", "l", "r"],
                )

    return reads.select("read_id", "seq").mapInArrow(run, "read_id long, j int, km long, fwd boolean, l byte, r byte")


def window_counts(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, n_windows, n_forward, n_distinct, n_left): windows of each read: all, those read as they are, distinct ones, those with a base to the left.

    A read's windows are cut and counted where it is; rows of one id come together and count as one read.
    """
    names = ["read_id", "n_windows", "n_forward", "n_distinct", "n_left"]

    def row(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the read that may go on: its id, counts and distinct k-mers
        for b in batches:
            ids, seqs = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for start, part in pieces(seqs):
                own = ids[start : start + len(part)]
                group = np.cumsum([n > 0 and own[n] != own[n - 1] for n in range(len(own))])
                read, _, km, forward, left, _ = windows(part, k)
                at, n = group[read], int(group[-1]) + 1
                order = np.lexsort((km, at))
                km, of = km[order], at[order]
                new = np.concatenate((np.ones(min(1, len(km)), bool), (km[1:] != km[:-1]) | (of[1:] != of[:-1])))
                km, of = km[new], of[new]
                cut = np.searchsorted(of, np.arange(n + 1))
                counts = [np.bincount(at, minlength=n), np.bincount(at[forward], minlength=n), np.diff(cut), np.bincount(at[left < 4], minlength=n)]
                found = list(zip([own[i] for i in np.searchsorted(group, np.arange(n)).tolist()], *(c.tolist() for c in counts)))
                if last and last[0][0] == found[0][0]:
                    seen, more = last[0], found[0]
                    both = np.union1d(last[1], km[: cut[1]])
                    found[0] = (seen[0], seen[1] + more[1], seen[2] + more[2], len(both), seen[4] + more[4])
                else:
                    both = km[: cut[1]]
                    if last:
                        found.insert(0, last[0])
                last = (found.pop(), both if n == 1 else km[cut[n - 1] :])
                found = [f for f in found if f[1]]
                if found:
                    yield row(found)
        if last and last[0][1]:
            yield row([last[0]])

    at = reads.select(F.col("read_id").cast("long").alias("read_id"), "seq").repartition("read_id").sortWithinPartitions("read_id")
    return at.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def kmer_table(reads: DataFrame, k: int, spelled: bool = False) -> DataFrame:
    """Canonical k-mers with their counts and capped link counts; ``spelled``: as letters, which are put together with numpy."""

    def work(chunks: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        known: tuple = ()
        for _, some in chunks:
            w = Windows(some, k, False)
            found = _counted(w.km, (w.left * 5 + w.right).astype(np.int8), None, k)
            known = _counted(*(np.concatenate(x) for x in zip(known, found)), k) if known else found
        km, side, n = known
        first = np.flatnonzero(np.diff(km, prepend=-1))
        sums = [np.minimum(CAP, np.add.reduceat(np.where(code == b, n, 0), first)).astype(np.int32) for code in (side // 5, side % 5) for b in range(4)]
        km, n = km[first], np.add.reduceat(n, first)
        for at in range(0, len(km), ROWS):
            some = slice(at, at + ROWS)
            yield pa.RecordBatch.from_arrays([_spelled(km[some], k) if spelled else pa.array(km[some]), *(pa.array(x[some]) for x in (n, *sums))], ["km", "cnt", *LINKS])

    return by_bucket(blocks(reads, k), f"km {'string' if spelled else 'long'}, cnt long, " + ", ".join(f"{c} int" for c in LINKS), work, together=True)


def _spelled(km: np.ndarray, k: int) -> pa.Array:
    letters = np.frombuffer(b"ACTG", np.uint8)[km[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(km), [None, pa.py_buffer(letters.tobytes())]).cast(pa.binary()).cast(pa.string())


def _counted(km: np.ndarray, side: np.ndarray, n: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (k-mer, side) rows and how often each occurs; ``n``: how often the given rows do, else once."""
    if k <= 29:  # both fit into one number
        key = (km << 5) | side
        if n is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        km, side = key[first] >> 5, (key[first] & 31).astype(np.int8)
    else:
        order = np.lexsort((side, km))
        km, side, n = km[order], side[order], n if n is None else n[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(km)), bool), (km[1:] != km[:-1]) | (side[1:] != side[:-1]))))
        km, side, size = km[first], side[first], len(km)
        return km, side, np.diff(np.append(first, size)) if n is None else np.add.reduceat(n, first)
    return km, side, np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n, first)


def without_rare_links(kmers: DataFrame, least: int) -> DataFrame:
    """Link counts of at most ``least`` become 0; k-mers left without any link go."""
    out = kmers.withColumns({c: F.when(F.col(c) > least, F.col(c)).otherwise(0) for c in LINKS})
    return out.where(" + ".join(LINKS) + " > 0") if least > 0 else out


def degree(side: list[str]) -> Column:
    return sum((F.col(c) > 0).cast("int") for c in side)


def marked(kmers: DataFrame) -> DataFrame:
    """Adds in- and out-degree, whether the k-mer was seen once, and whether it is linear."""
    out = kmers.withColumns({"n_left": degree(LEFT), "n_right": degree(RIGHT), "single": F.col("cnt") == 1})
    return out.withColumn("linear", (F.col("n_left") == 1) & (F.col("n_right") == 1))


def frequency(kmers: DataFrame) -> DataFrame:
    """(bin, n): k-mers by the greater sum of links of a side (at most 255); k-mers seen once are in bin 1."""
    most = F.greatest(sum(F.col(c) for c in LEFT), sum(F.col(c) for c in RIGHT))
    at = F.when(F.col("cnt") == 1, 1).otherwise(F.least(most, F.lit(255))).cast("long")
    return kmers.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _with_rc(df: DataFrame, word: str, name: str, k: int) -> DataFrame:
    """Adds the packed reverse complements of a column, by numpy: an expression that swaps halves of ever smaller groups doubles with each step."""

    @F.pandas_udf("long")
    def back(code: pd.Series) -> pd.Series:
        return pd.Series(reverse(np.ascontiguousarray(code.to_numpy(np.int64)), k))

    return df.withColumn(name, back(word))


def neighbours(kmers: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(km, side, base, n, nbr, nbr_side, nbr_base): each live link with its k-mer and the reciprocal link there.

    Only sides of ``least`` links or more are looked at; others are left out before rows are made of links.
    """
    mask = F.lit((1 << 2 * k) - 1).cast("long")
    side = lambda s: F.array(*(F.struct(F.lit(s).alias("side"), F.lit(b).alias("base"), F.col(f"{s}{b}").alias("n")) for b in range(4)))
    left, right = degree(LEFT) >= least, degree(RIGHT) >= least
    entries = F.when(left & right, F.concat(side("l"), side("r"))).when(left, side("l")).otherwise(side("r"))
    links = kmers.where(left | right).select("km", F.explode(entries).alias("e")).select("km", "e.*").where("n > 0")
    first = F.shiftright("km", 2 * (k - 1)).cast("int")
    last = F.col("km").bitwiseAND(F.lit(3)).cast("int")
    right = F.shiftleft("km", 2).bitwiseAND(mask).bitwiseOR(F.col("base").cast("long"))
    left = F.shiftright("km", 2).bitwiseOR(F.shiftleft(F.col("base").cast("long"), 2 * (k - 1)))
    word = F.when(F.col("side") == "r", right).otherwise(left)
    links = links.withColumn("word", word)
    links = _with_rc(links, "word", "back", k)
    own = F.col("word") < F.col("back")
    end = F.when(F.col("side") == "r", first).otherwise(last)
    return links.select(
        "km", "side", "base", "n",
        F.least("word", "back").alias("nbr"),
        F.when(own, F.when(F.col("side") == "r", "l").otherwise("r")).otherwise(F.col("side")).alias("nbr_side"),
        F.when(own, end).otherwise(end.bitwiseXOR(F.lit(2))).alias("nbr_base"),
    )


def counts_of(links: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """``links`` with ``nbr_cnt``, the count of the k-mer that each leads to; links to no k-mer of the reads go.

    Few k-mers branch: theirs are looked up where the windows of reads are counted, and the table of all k-mers isn't joined.
    """

    def work(chunks: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        known: tuple = ()
        for kind, some in chunks:
            if kind:
                if known:
                    want = np.unique(asked_for(some))
                    at = np.minimum(np.searchsorted(known[0], want), len(known[0]) - 1)
                    hit = known[0][at] == want
                    yield pa.RecordBatch.from_arrays([pa.array(want[hit]), pa.array(known[1][at[hit]])], ["nbr", "nbr_cnt"])
                continue
            km = np.sort(Windows(some, k, False).km)
            first = np.flatnonzero(np.diff(km, prepend=-1))
            found = km[first], np.diff(np.append(first, len(km)))
            if known:
                km, n = (np.concatenate(x) for x in zip(known, found))
                order = np.argsort(km, kind="stable")
                km, n = km[order], n[order]
                first = np.flatnonzero(np.diff(km, prepend=-1))
                found = km[first], np.add.reduceat(n, first)
            known = found

    both = blocks(reads, k).unionByName(asked(links, k, "nbr"))
    counts = by_bucket(both, "nbr long, nbr_cnt long", work).distinct()  # a k-mer may be asked for in several chunks
    return links.join(counts, "nbr")


def branches(kmers: DataFrame, k: int, reads: DataFrame | None = None) -> DataFrame:
    """(km, side, base, n, nbr, nbr_cnt): the links of branching sides, with the count of the k-mer they lead to.

    With the ``reads`` that the table was made of, unchanged since, counts are looked up there.
    """
    links = neighbours(kmers, k, 2).select("km", "side", "base", "n", "nbr")
    if reads is not None:
        return counts_of(cut(links), reads, k)
    return links.join(kmers.select(F.col("km").alias("nbr"), F.col("cnt").alias("nbr_cnt")), "nbr")


def branch_peaks(kmers: DataFrame, k: int, reads: DataFrame | None = None) -> DataFrame:
    """(km, side, links, peak): of each branching side the largest count of a neighbour."""
    return branches(kmers, k, reads).groupBy("km", "side").agg(F.count(F.lit(1)).cast("long").alias("links"), F.max("nbr_cnt").alias("peak")).where("links > 1")


def doomed_neighbours(kmers: DataFrame, k: int, percent: int = 5, reads: DataFrame | None = None) -> DataFrame:
    """(km): k-mers with under ``percent`` of the count of the largest neighbour on some branching side."""
    side = Window.partitionBy("km", "side")  # four rows at most
    at = branches(kmers, k, reads).withColumn("peak", F.max("nbr_cnt").over(side)).withColumn("links", F.count(F.lit(1)).over(side))
    return at.where((F.col("links") > 1) & (F.col("nbr_cnt") * 100 < F.col("peak") * percent)).select(F.col("nbr").alias("km")).distinct()


def without(kmers: DataFrame, doomed: DataFrame, k: int) -> DataFrame:
    """The table without some k-mers, whose links in other k-mers become 0."""
    dead = neighbours(kmers.join(doomed, "km", "left_semi"), k).select(F.col("nbr").alias("km"), F.concat("nbr_side", F.col("nbr_base").cast("string")).alias("link"))
    lost = dead.groupBy("km").agg(F.collect_set("link").alias("lost"))  # 8 at most
    out = kmers.join(doomed, "km", "left_anti").join(lost, "km", "left")
    gone = lambda c: F.coalesce(F.array_contains("lost", c), F.lit(False))
    return out.withColumns({c: F.when(gone(c), 0).otherwise(F.col(c)) for c in LINKS}).drop("lost")


def local_filter(kmers: DataFrame, k: int, percent: int = 5) -> DataFrame:
    """One synchronous round of relative filtering at branching sides."""
    return without(kmers, doomed_neighbours(kmers, k, percent), k)
