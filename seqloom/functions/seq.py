"""Column functions on sequences over the letters A, C, T, G (in that order).

The letter rule, complements and canonical order are fixed values of the data model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# Every letter's base, '.' as A; complements; digits in canonical order.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ."
BASES = "ACCTTGGAACCTTGGAACCTTGGAACA"
ORDER = "ACTG"
COMPLEMENT = "TGAC"
DIGITS = "0123"


def normalize(text: Column) -> Column:
    """Letters to bases; everything that is neither a letter nor a dot is skipped. Null stays null."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z.]", "")), LETTERS, BASES)


_TO_BASE = bytes.maketrans((LETTERS + LETTERS[:-1].lower()).encode(), (BASES + BASES[:-1]).encode())
_NO_BASE = bytes(sorted(set(range(256)) - set((LETTERS + LETTERS.lower()).encode())))
_RC, _DIGIT = bytes.maketrans(ORDER.encode(), COMPLEMENT.encode()), bytes.maketrans(ORDER.encode(), DIGITS.encode())


def bases(df: DataFrame, text: str, seq: str = "seq", least: int = 0, strands: bool = False) -> DataFrame:
    """``df`` with ``normalize``d texts in place of column ``text``; those of fewer than ``least`` bases and, if that is over 0, null ones go.

    ``strands`` adds ``rc``, the reverse complement, ``own``, whether the sequence is its canonical form, and ``n_gc``, its G and C letters.
    Texts are translated as bytes where Spark's own functions look up each letter.
    """
    rest = [c for c in df.columns if c != text]
    fields = [*df.select(*rest).schema.fields, StructField(seq, StringType())]
    fields += [StructField("rc", StringType()), StructField("own", BooleanType()), StructField("n_gc", IntegerType())] if strands else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if t is None else t.translate(_TO_BASE, _NO_BASE) for t in b.column(len(rest)).cast(pa.binary()).to_pylist()]
            keep = [n for n, s in enumerate(found) if not least or s is not None and len(s) >= least]
            found = [found[n] for n in keep]
            out = [c.take(pa.array(keep, pa.int64())) if len(keep) < b.num_rows else c for c in b.columns[: len(rest)]]
            out.append(pa.array(found, pa.binary()).cast(pa.string()))
            if strands:
                back = [None if s is None else s.translate(_RC)[::-1] for s in found]
                own = [None if s is None else s.translate(_DIGIT) < r.translate(_DIGIT) for s, r in zip(found, back)]
                out += [pa.array(back, pa.binary()).cast(pa.string()), pa.array(own, pa.bool_()), pa.array([None if s is None else s.count(b"G") + s.count(b"C") for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])
        pa.default_memory_pool().release_unused()

    return df.select(*rest, text).mapInArrow(run, StructType(fields))


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters without a complement stay."""
    return F.reverse(F.translate(seq, ORDER, COMPLEMENT))


def digits(seq: Column) -> Column:
    """Base digits; equal lengths compare as the packed numbers do."""
    return F.translate(seq, ORDER, DIGITS)


def is_canonical(kmer: Column) -> Column:
    """Whether a word is smaller than its reverse complement (a palindrome is not)."""
    return digits(kmer) < digits(revcomp(kmer))


def canonical(kmer: Column) -> Column:
    return F.when(is_canonical(kmer), kmer).otherwise(revcomp(kmer))


def next_kmer(kmer: Column, base: Column) -> Column:
    return F.concat(F.substring(kmer, 2, 1 << 20), base)


def prev_kmer(kmer: Column, base: Column) -> Column:
    return F.concat(base, F.left(kmer, F.length(kmer) - 1))


def pack(seq: Column) -> Column:
    """Base-4 number of up to 31 letters."""
    return F.conv(digits(seq), 4, 10).cast("long")


def unpack(code: Column, k: int) -> Column:
    """Letters of a packed word of k letters."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), DIGITS, ORDER)


def shard(seq: Column, parts: int) -> Column:
    """The shard of a word: 24 bits of its crc32, modulo the number of shards."""
    return F.crc32(seq.cast("binary")).bitwiseAND(0xFFFFFF) % parts


def oriented(seq: Column, reverse: Column) -> Column:
    """Strand normalisation: libraries marked reverse are complemented."""
    return F.when(reverse, revcomp(seq)).otherwise(seq)


def twin(strand: Column) -> Column:
    return F.when(strand == "+", "-").otherwise("+")


def gc(seq: Column) -> Column:
    """Count of G and C letters."""
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def _lcs(a: str, b: str) -> np.ndarray:
    """Table of longest common subsequence lengths; rows follow a."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    t = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, c in enumerate(x):
        t[i + 1, 1:] = np.maximum.accumulate(np.maximum(t[i, 1:], t[i, :-1] + (y == c)))
    return t


#: Cells of the alignment tables of pairs that are worked out together.
LCS_CELLS = 1 << 22


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequence lengths of many pairs: one row of all their tables at a time, pairs of like lengths together."""
    out = np.zeros(len(a), np.int32)
    order = sorted(range(len(a)), key=lambda n: (len(b[n]), len(a[n])))
    at = 0
    while at < len(order):
        part = order[at : at + max(1, LCS_CELLS // (len(b[order[at]]) + 1))]
        part = [n for n in part if len(b[n]) <= len(b[part[0]]) + 16]
        at += len(part)
        wide = max(len(b[n]) for n in part)
        y = np.full((len(part), wide), 0xFFFFFFFF, np.uint32)  # no letter
        for i, n in enumerate(part):
            y[i, : len(b[n])] = np.frombuffer(b[n].encode("utf-32-le", "surrogatepass"), np.uint32)
        left = sorted(range(len(part)), key=lambda i: -len(a[part[i]]))
        x = [np.frombuffer(a[part[i]].encode("utf-32-le", "surrogatepass"), np.uint32) for i in left]
        y, row = y[left], np.zeros((len(part), wide + 1), np.int32)
        live = len(part)
        for i in range(len(x[0])):  # the longest first: pairs that are done are at the end
            while live and len(x[live - 1]) <= i:
                live -= 1
            c = np.array([s[i] for s in x[:live]], np.uint32)
            step = np.maximum(row[:live, 1:], row[:live, :-1] + (y[:live] == c[:, None]))
            row[:live, 1:] = np.maximum.accumulate(step, 1)
        for i, r in zip(left, row[:, -1]):
            out[part[i]] = r
    return out


@F.pandas_udf(IntegerType())
def lcs_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Alignment score: 1 a match, 0 a mismatch or gap. Null if either is."""
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    if known.any():
        out[known] = lcs_lengths(a[known].tolist(), b[known].tolist())
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def lcs_trace(a: pd.Series, b: pd.Series) -> pd.Series:
    """For each letter of a, the place in b (from 0) that it aligns to; -1 for a gap."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        t, i, j = _lcs(x, y), len(x), len(y)
        to = [-1] * len(x)
        while i and j:
            if t[i, j] == t[i - 1, j]:
                i -= 1
            elif t[i, j] == t[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                to[i] = j
        out.append(to)
    return pd.Series(out)


def alike(a: Column, b: Column, k: int, differ: int = 2, share: float = 0.10) -> Column:
    """Whether two path sequences may merge: lengths within ``differ``, neither under k - 1, few mismatches."""
    longest = F.greatest(F.length(a), F.length(b))
    score = lcs_score(a, b)
    return (
        (F.abs(F.length(a) - F.length(b)) <= differ)
        & (F.least(F.length(a), F.length(b)) >= k - 1)
        & (score >= longest - differ)
        & (1 - score / longest <= share)
    )
