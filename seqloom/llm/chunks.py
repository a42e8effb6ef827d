"""A bounded memo from text chunks to dense numbers, and ragged columns that go with it.

Large corpora repeat most of their words. The text operators cut every whole text
into chunks that can be treated apart, work each distinct chunk out once in a batch,
and gather per document with numpy. The memo only saves repeated work: it is emptied
when full, so memory stays bounded and results never depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Ragged:
    """An append-only list of integer rows in one flat array."""

    def __init__(self, dtype=np.int32):
        self.flat, self.used, self.dtype = np.empty(1 << 12, dtype), 0, dtype
        self.start, self.count, self.rows = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int32), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        b = np.empty(max(n, 2 * len(a)), a.dtype)
        b[: len(a)] = a
        return b

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(counts), len(flat)
        self.flat = self._room(self.flat, self.used + m)
        self.flat[self.used : self.used + m] = flat
        self.start = self._room(self.start, self.rows + n)
        self.count = self._room(self.count, self.rows + n)
        self.count[self.rows : self.rows + n] = counts
        self.start[self.rows : self.rows + n] = self.used + np.cumsum(counts) - counts
        self.used, self.rows = self.used + m, self.rows + n

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The rows, one after the other."""
        counts = self.count[rows].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[rows] - ends + counts, counts) + np.arange(total)]


def words(texts: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (between ASCII white space) of some texts, the words of all texts in a row as numbers of these, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    coded = split.flatten().dictionary_encode()
    index, counts = coded.indices.to_numpy().astype(np.int64), np.diff(split.offsets.to_numpy()).astype(np.int64)
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # of a text without words
        kept = index != blank
        index, counts = index[kept], sums(kept.astype(np.int64), counts)
        index -= index > blank
        del distinct[blank]
    return distinct, index, counts


class ChunkMemo(dict):
    """chunk -> number; ``resolve(new chunks)`` is called once a batch, before numbers are used."""

    def __init__(self, resolve: Callable[[list], None], reset: Callable[[], None], limit: int = 300_000, limit_bytes: int = 10 << 20):
        super().__init__()
        self.resolve, self.reset, self.limit, self.limit_bytes = resolve, reset, limit, limit_bytes
        self.held = 0

    def distinct(self, chunks: list) -> np.ndarray:
        """Numbers of chunks that are all different."""
        if len(self) > self.limit or self.held > self.limit_bytes:
            self.clear()
            self.held = 0
            self.reset()
        known = list(map(self.get, chunks))
        fresh = [c for c, n in zip(chunks, known) if n is None]
        if fresh:
            new = iter(range(len(self), len(self) + len(fresh)))
            known = [next(new) if n is None else n for n in known]
            self.update(zip(fresh, range(len(self), len(self) + len(fresh))))
            self.held += sum(map(len, fresh))
            self.resolve(fresh)
        return np.array(known, np.int64)

    def of(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of all texts in a row, and how many each text has."""
        found, index, counts = words(texts)
        return self.distinct(found)[index], counts

    def numbers(self, parts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are in chunks already."""
        first: dict = {}
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        index = np.fromiter((first.setdefault(c, len(first)) for c in chain.from_iterable(parts)), np.int64, int(counts.sum()))
        return self.distinct(list(first))[index], counts


def parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the numbers below n that links (i, j) connect each with."""
    part = np.arange(n)
    while (part[i] != part[j]).any():
        low = np.minimum(part[i], part[j])
        np.minimum.at(part, part[i], low)
        np.minimum.at(part, part[j], low)
        while (part != part[part]).any():
            part = part[part]
    return part


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's run of values; empty runs give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def flat(rows: Iterable[list], dtype=np.int32) -> tuple[np.ndarray, np.ndarray]:
    rows = list(rows)
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), dtype, int(counts.sum())), counts
