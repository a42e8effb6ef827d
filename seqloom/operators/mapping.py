"""Reads onto contigs: the index of unique k-mers, votes, placements, gap reads.

The index has a k-mer at most once, so a read's windows meet at most one row each and
hits grow with the reads only. Contigs and reads travel in ``blocks`` and meet in the buckets of their k-mers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.seq import bases, twin
from seqloom.operators.blocks import Windows, blocks, by_bucket
from seqloom.operators.rank import numbered


def contigs_of_lines(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(contig_id, seq, len): the distinct lines of texts as contigs, one strand each, numbered by length and sequence."""
    lines = bases(docs.select(F.explode(F.split(text, "\n")).alias("line")), "line", least=k + 2, strands=True)
    lines = lines.select(F.when(F.col("own"), F.col("seq")).otherwise(F.col("rc")).alias("seq"))
    return numbered(contigs(lines, k), ["len", "seq"], "contig_id").select("contig_id", "seq", "len")


def contigs(seqs: DataFrame, k: int) -> DataFrame:
    """Distinct sequences long enough to be mapped to; ``len`` is the length without the first k-mer."""
    return seqs.where(F.length("seq") >= k + 2).select("seq").distinct().withColumn("len", F.length("seq") - k)


def unique_kmers(contigs: DataFrame, k: int) -> DataFrame:
    """(km, contig_id, pos, ctg_fwd): canonical k-mers that occur once in all contigs."""

    def work(chunks: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _index(chunks, k)], ["km", "contig_id", "pos", "ctg_fwd"])

    return by_bucket(blocks(contigs, k, "contig_id"), "km long, contig_id long, pos int, ctg_fwd boolean", work, together=True)


def _index(chunks: Iterable[tuple[int, list[bytes]]], k: int) -> list[np.ndarray]:
    """(km, read, place, fwd) of the k-mers that occur once, by k-mer."""
    parts = []
    for _, some in chunks:
        w = Windows(some, k, True)
        parts.append((w.km, w.read, w.place, w.fwd))
    km, *rest = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(km, kind="stable")
    new = np.diff(km[order], prepend=-1) != 0
    order = order[new & np.append(new[1:], True)]
    return [km[order], *(x[order] for x in rest)]


def votes(reads: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """(read_id, contig_id, votes, first): unique k-mers that a read and a contig share, and the first one's (j, pos, same).

    Reads and contigs meet in the buckets of their k-mers, where votes are added up before they are sent on.
    """

    def work(chunks: Iterator[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        chunks = iter(chunks)
        index, rest = [], None
        for kind, some in chunks:
            if kind:
                rest = chain([(kind, some)], chunks)
                break
            index.append((kind, some))
        if not index or rest is None:
            return
        km, contig, pos, way = _index(index, k)
        if not len(km):
            return
        for _, some in rest:
            w = Windows(some, k, True)
            at = np.minimum(np.searchsorted(km, w.km), len(km) - 1)
            hit = np.flatnonzero(km[at] == w.km)
            at, read, j = at[hit], w.read[hit], w.place[hit]
            to, where, same = contig[at], pos[at], w.fwd[hit] == way[at]
            order = np.lexsort((same, where, j, to, read))
            read, to, j, where, same = (x[order] for x in (read, to, j, where, same))
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(read)), bool), (read[1:] != read[:-1]) | (to[1:] != to[:-1]))))
            n = np.diff(np.append(first, len(read)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (read[first], to[first], n, j[first], where[first], same[first])], ["read_id", "contig_id", "n", "j", "pos", "same"])

    both = blocks(contigs, k, "contig_id").unionByName(blocks(reads, k, "read_id", 1))
    some = by_bucket(both, "read_id long, contig_id long, n long, j int, pos int, same boolean", work)
    return some.groupBy("read_id", "contig_id").agg(F.sum("n").alias("votes"), F.min(F.struct("j", "pos", "same")).alias("first"))


def least_votes(read_len: Column, k: int, map_len: int = 32, insert: int = 0) -> Column:
    """K-mers of a contig that a read needs: 5 at least, all of its mappable length.

    That is 32 bases or more; for an insert of over 1000, 35 or more and over half of the read.
    """
    if insert > 1000:
        length = F.greatest(F.lit(max(35, map_len)), F.floor(read_len / 2).cast("int") + 1)
    else:
        length = F.lit(max(32, map_len))
    return F.greatest(F.lit(5), F.least(read_len, length) - k + 1)


def placements(reads: DataFrame, contigs: DataFrame, k: int, map_len: int = 32, insert: int = 0) -> DataFrame:
    """(read_id, contig_id, strand, read_off, ctg_off, start, votes): where reads lie, one row a read and contig."""
    sizes = reads.select("read_id", F.length("seq").alias("read_len"))
    placed = votes(reads, contigs, k).join(sizes, "read_id").where(F.col("votes") >= least_votes(F.col("read_len"), k, map_len, insert))
    placed = placed.join(contigs.select("contig_id", "len"), "contig_id")
    off = F.when(F.col("first.same"), F.col("first.pos")).otherwise(F.col("len") - F.col("first.pos"))
    return placed.select(
        "read_id", "contig_id",
        F.when(F.col("first.same"), "+").otherwise("-").alias("strand"),
        F.col("first.j").alias("read_off"),
        off.alias("ctg_off"),
        (off - F.col("first.j")).alias("start"),
        "votes",
    )


def best_placements(placed: DataFrame) -> DataFrame:
    """One placement a read: the last along the read for odd ids, the first for even ones."""
    row = F.struct("read_off", "contig_id", *[c for c in placed.columns if c not in ("read_id", "read_off", "contig_id")])
    sign = F.when(F.col("read_id") % 2 == 1, -F.col("read_off")).otherwise(F.col("read_off"))
    best = placed.groupBy("read_id").agg(F.min_by(row, F.struct(sign, F.col("contig_id"))).alias("b"))
    return best.select("read_id", "b.*")


def gap_reads(best: DataFrame, insert: int, k: int, contigs: DataFrame) -> DataFrame:
    """(read_id, contig_id, dis): reads without a placement, laid by their mate's: mates are ids 2n - 1 and 2n."""
    pair = F.floor((F.col("read_id") + 1) / 2)
    sizes = contigs.select("contig_id", "len")
    placed = best.withColumn("pair", pair).join(sizes, "contig_id")
    lone = placed.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("read_id"), F.min("contig_id").alias("contig_id"), F.min("strand").alias("strand"), F.min("start").alias("start"), F.min("len").alias("len")).where("n = 1")
    mate = F.when(F.col("read_id") % 2 == 1, F.col("read_id") + 1).otherwise(F.col("read_id") - 1)
    return lone.select(mate.alias("read_id"), "contig_id", twin(F.col("strand")).alias("strand"), (F.col("start") + insert - F.col("len")).alias("dis"))


def read_on_scaffolds(placed: DataFrame, layout: DataFrame, k: int) -> DataFrame:
    """(read_id, read_off, scaf, scaf_pos, strand, align_len): placements on contigs carried over to scaffolds.

    ``layout`` has each contig once: (scaf, ord, contig_id, strand, len, start). A scaffold's later contigs are written from base k on, so
    what a read covers of the bases before is not counted; a read of which nothing is left there goes.
    """
    at = placed.select("read_id", "contig_id", "read_off", "ctg_off", "votes", F.col("strand").alias("own")).join(layout, "contig_id")
    same = F.col("own") == F.col("strand")
    off = F.when(same, F.col("ctg_off")).otherwise(F.col("len") - F.col("ctg_off"))
    at = at.withColumn("off", off).withColumn("lost", F.when(F.col("start") > 0, F.greatest(F.lit(0), k - F.col("off"))).otherwise(0))
    return at.select(
        "read_id", "read_off", "scaf", (F.col("start") + F.col("off") + F.col("lost")).cast("long").alias("scaf_pos"), F.when(same, "+").otherwise("-").alias("strand"),
        (F.col("votes") + k - 1 - F.col("lost")).cast("long").alias("align_len"),
    ).where("align_len > 0")
