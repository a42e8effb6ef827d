"""Operator 6: a quality classifier, hashed word n-grams under logistic regression.

Features of a text, hashed to ``BUCKETS``: its tokens (words, lower-cased, and runs of
other signs), their shapes (case and digits, runs shortened), pairs of neighbouring
tokens and of neighbouring shapes, and a mark for each word that repeats the one
before it. A feature's value is its share of the text's features times ``SCALE``.

The weights are trained by follow-the-regularised-leader updates, one document at a
time, on a bounded sample of labelled rows (see ``labels.sample``). A score is the
sparse dot product of weights and values, as a probability. It is a sum over words
and neighbouring words, so each distinct word is featurised once in a batch.

Null and empty texts have no features: their score is the bias's. An empty table gives
an empty result; with no labelled rows at all the score is 0.5.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm.chunks import ChunkMemo, Ragged, sums
from seqloom.llm.common import filter_text, kept, map_text

BUCKETS = 1 << 18
SCALE = 20.0
EPOCHS = 3
#: Rates and penalties of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_RUN = re.compile(r"(.)\1+", re.S)
#: Multipliers that mix two token hashes into one bucket.
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(token: str) -> str:
    """Letters by case, digits as 9, other signs as they are; runs cut to two."""
    if token.isalpha():
        tail = token[1:]
        if token.islower():
            return "xx" if tail else "x"
        if token.isupper():
            return "XX" if tail else "X"
        if tail.islower() and token[0].isupper():
            return "Xxx" if len(tail) > 1 else "Xx"
    return _RUN.sub(r"\1\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in token))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Buckets of pairs."""
    return ((a.astype(np.uint64) * _MIX[0] + b.astype(np.uint64) * _MIX[1]) >> np.uint64(64 - 18)).astype(np.int64)


SAME = zlib.crc32(b"\x00same") % BUCKETS


class Features:
    """Features of texts, by chunks between ASCII white space."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.reset()
        self.memo = ChunkMemo(self.resolve, self.reset)

    def reset(self) -> None:
        self.inner = Ragged()
        self.ends = np.empty((4, 0), np.int64)  # first token, first shape, last token, last shape
        self.weight = np.empty(0)

    def resolve(self, chunks: list[bytes]) -> None:
        crc, find = zlib.crc32, _TOKEN.findall
        found = [find(t) or [t] for t in (c.decode() for c in chunks)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        size = int(counts.sum())
        tokens = np.fromiter((crc(t.lower().encode()) for f in found for t in f), np.int64, size)
        shapes = np.fromiter((crc(shape(t).encode(), 1) for f in found for t in f), np.int64, size)
        chunk = np.repeat(np.arange(len(chunks)), counts)
        last = np.cumsum(counts) - 1
        first = last - counts + 1
        self.ends = np.concatenate((self.ends, (tokens[first], shapes[first], tokens[last], shapes[last])), 1)
        pair = np.flatnonzero(chunk[:-1] == chunk[1:])
        pairs = [mix(k[pair], k[pair + 1]) for k in (tokens, shapes)]
        of = np.concatenate((chunk, chunk, chunk[pair], chunk[pair]))
        order = np.argsort(of, kind="stable")
        rows = np.concatenate((tokens % BUCKETS, shapes % BUCKETS, *pairs))[order]
        counts = np.bincount(of, minlength=len(chunks))
        self.inner.extend(rows, counts)
        if self.weights is not None:
            self.weight = np.concatenate((self.weight, sums(self.weights[rows], counts)))

    def between(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets that span neighbouring chunks: token pairs, shape pairs, and whether the two are the same."""
        e = self.ends[:, numbers]
        return mix(e[2, :-1], e[0, 1:]), mix(e[3, :-1], e[1, 1:]), numbers[:-1] == numbers[1:]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's buckets and their values."""
        numbers, _ = self.memo.of(pa.array([text], pa.string()))
        parts = [self.inner.gather(numbers)]
        if len(numbers) > 1:
            tokens, shapes, same = self.between(numbers)
            parts += [tokens, shapes, np.full(int(same.sum()), SAME)]
        buckets, n = np.unique(np.concatenate(parts), return_counts=True)
        return buckets, n * (SCALE / max(1, n.sum()))

    def dots(self, texts: pa.StringArray) -> np.ndarray:
        """The dot product of each text's values with the weights."""
        numbers, counts = self.memo.of(texts)
        total = sums(self.weight[numbers], counts)
        n = sums(self.inner.count[numbers].astype(np.int64), counts)
        if len(numbers) > 1:
            tokens, shapes, same = self.between(numbers)
            inside = np.ones(len(numbers) - 1, bool)
            ends = np.cumsum(counts)
            inside[ends[(ends > 0) & (ends < len(numbers))] - 1] = False
            w = (self.weights[tokens] + self.weights[shapes] + same * self.weights[SAME]) * inside
            pairs = np.maximum(counts - 1, 0)
            at = np.concatenate((w, [0.0]))
            total += sums(at, counts)
            n += 2 * pairs + sums(np.concatenate(((same & inside).astype(np.int64), [0])), counts)
        return total * (SCALE / np.maximum(1, n))


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader updates."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the bias comes last
    make = Features()
    data = []
    for text, label in rows:
        at, value = make.of(text)
        data.append((np.append(at, BUCKETS).astype(np.int32), np.append(value, 1.0).astype(np.float32), label))

    def leader(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    random = np.random.default_rng(11)
    for _ in range(epochs):
        for i in random.permutation(len(data)):
            at, value, label = data[i]
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(np.arange(BUCKETS + 1))
    return w[:-1], float(w[-1])


def _loaded(docs: DataFrame, model: tuple):
    """A function that gives a task its featuriser and the bias."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # BUCKETS weights
    return lambda: (kept(name, lambda: Features(shared.value[0])), shared.value[1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``key`` columns and the probability of label 1."""
    load = _loaded(docs, model)

    def make():
        features, bias = load()
        return lambda texts: [pa.array(1 / (1 + np.exp(-np.clip(features.dots(texts) + bias, -35, 35))))]

    return map_text(docs, key, text, f"{out} double", make, "arrow")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """The documents that score 0.5 or more, with all their columns."""
    load = _loaded(docs, model)

    def make():
        features, bias = load()
        return lambda texts: features.dots(texts) + bias >= 0

    return filter_text(docs, text, make)
