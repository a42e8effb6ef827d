"""Operator 10: toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of the hashed byte n-grams of ``<word>`` (lengths ``GRAMS``) and of the
word itself; its vector is their mean, so misspellings never seen share most of their
vectors with words that were. A window of ``WINDOW`` words is the mean of their vectors,
which a linear softmax turns into the odds of label 1; embeddings and softmax are
trained jointly in numpy. A word that repeats the one before it is skipped. A few toxic words decide a long document, so windows are the
unit: the score of a text is its highest window's, and after the first epoch training
takes, of each document, the window that scores highest now (labelled as the document)
and some random ones of unlabelled-1 documents. A logistic fit calibrates scores: of the
documents' highest window odds under models that haven't seen them (``FOLDS`` of them), as
documents that trained a model score lower or higher than others.

A text shorter than a window is one window padded with nothing. Null and empty texts
have one empty window. The sample that trains is bounded (``labels.sample``); every word
of every text is scored. With no labelled rows of both kinds the score is the share of
label 1 in the sample, or 0 without any.
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

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIM = 8
WINDOW, STRIDE = 16, 4
EPOCHS = 8
BATCH = 256
RATE = 0.5
#: Parts of the sample that are each judged by a model of the rest, for the calibration.
FOLDS = 3

_EDGE = re.compile(r"^\W+|\W+$")


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``<word>``, and the whole word, for many words in a row."""
    padded = [b"<" + w + b">" for w in words]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[word]
    at = np.arange(len(data))
    found, of = [np.fromiter((zlib.crc32(w) % BUCKETS for w in padded), np.int64, len(padded))], [np.arange(len(words))]
    for n in GRAMS:
        ok = np.flatnonzero(at + n <= end)
        h = np.full(len(ok), 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ data[ok + k]) * np.uint32(16777619)
        found.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64))
        of.append(word[ok])
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return found[order], np.bincount(of, minlength=len(words))


class Words:
    """Numbers for the words of texts; their n-grams, or under a model their odds."""

    def __init__(self, odds: np.ndarray | None = None):
        self.bucket_odds = odds
        self.reset()
        self.memo = ChunkMemo(self.resolve, self.reset)

    def reset(self) -> None:
        self.grams, self.odds = Ragged(), np.empty(0)

    def resolve(self, chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), 1 << 15):
            words = [_EDGE.sub("", c.decode().lower()).encode() or c for c in chunks[at : at + (1 << 15)]]
            found, counts = grams(words)
            if self.bucket_odds is None:
                self.grams.extend(found, counts)
            else:
                self.odds = np.concatenate((self.odds, sums(self.bucket_odds[found], counts) / counts))

    def numbered(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts in a row, without those that repeat the one before, and how many each text has."""
        numbers, counts = self.memo.of(texts)
        kept = np.ones(len(numbers), bool)
        kept[1:] = numbers[1:] != numbers[:-1]
        begins = np.cumsum(counts) - counts
        kept[begins[counts > 0]] = True
        return numbers[kept], sums(kept.astype(np.int64), counts)

    def highest(self, texts: pa.StringArray) -> np.ndarray:
        """Each text's highest sum of word odds in a window."""
        numbers, counts = self.numbered(texts)
        run = np.concatenate(([0.0], np.cumsum(self.odds[numbers])))
        start, text = windows(counts)
        stop = np.minimum(start + WINDOW, np.cumsum(counts)[text])
        return np.maximum.reduceat(run[stop] - run[start], np.searchsorted(text, np.arange(len(texts)))) if len(texts) else np.empty(0)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows (among all words in a row), and each one's text. Every text has at least one."""
    n = np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1
    text = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[text] + nth * STRIDE, text


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, folds: int = FOLDS) -> tuple[np.ndarray, float, float]:
    """Odds of each bucket (embedding times softmax weights), and the calibration's slope and intercept."""
    label = np.array([y for _, y in rows], np.int64)
    share = label.mean() if len(label) else 0.0
    if not 0 < share < 1:
        return np.zeros(BUCKETS), 0.0, 35.0 * (2 * share - 1)
    sample = Sample(pa.array([t for t, _ in rows], pa.string()), label)
    fold = np.empty(len(label), np.int64)  # as many of each label in every fold
    for y in (0, 1):
        fold[label == y] = np.arange((label == y).sum()) % folds
    apart, seen = np.zeros(len(label)), np.zeros(len(label), bool)
    for k in range(folds):
        rest = fold != k
        if 0 < label[rest].mean() < 1:
            apart[~rest], seen[~rest] = sample.highest(sample.fit(rest, epochs))[~rest], True
    odds = sample.fit(np.ones(len(label), bool), epochs)
    if not seen.any():  # a label with one row
        apart, seen = sample.highest(odds), ~seen
    slope, intercept = calibrated(apart[seen], label[seen])
    return odds, slope, intercept


class Sample:
    """Labelled texts as windows of numbered words."""

    def __init__(self, texts: pa.StringArray, label: np.ndarray):
        words = Words()
        words.memo.limit = words.memo.limit_bytes = 1 << 62  # the sample is bounded
        self.label, self.numbers, counts = label, *words.numbered(texts)
        self.every = words.grams
        self.start, self.text = windows(counts)
        self.stop = np.minimum(self.start + WINDOW, np.cumsum(counts)[self.text])
        self.first = np.searchsorted(self.text, np.arange(len(texts)))

    def window_odds(self, odds: np.ndarray) -> np.ndarray:
        """Each window's sum of word odds, from the buckets' odds."""
        count = self.every.count[: self.every.rows].astype(np.int64)
        word = sums(odds[self.every.flat[: self.every.used]], count) / count
        run = np.concatenate(([0.0], np.cumsum(word[self.numbers])))
        return run[self.stop] - run[self.start]

    def highest(self, odds: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(self.window_odds(odds), self.first)

    def fit(self, used: np.ndarray, epochs: int) -> np.ndarray:
        """The buckets' odds, from the texts that are ``used``."""
        random = np.random.default_rng(5)
        model = Softmax(random)
        label, text, n = self.label, self.text, int(used.sum())
        mine = used[text]
        clean, toxic = np.flatnonzero(mine & (label[text] == 0)), np.flatnonzero(mine & (label[text] == 1))
        for epoch in range(epochs):
            if epoch:
                odds = self.window_odds(model.odds())
                best = np.flatnonzero((odds == np.maximum.reduceat(odds, self.first)[text]) & mine)
                best = best[np.concatenate(([True], text[best][1:] != text[best][:-1]))]
                chosen = np.concatenate((best, random.choice(clean, min(len(clean), 2 * n), replace=False)))
            else:
                some = random.choice(toxic, min(len(toxic), 12 * n), replace=False)
                chosen = np.concatenate((some, random.choice(clean, min(len(clean), len(some)), replace=False)))
            chosen = random.permutation(chosen)
            for k in range(0, len(chosen), BATCH):
                self.step(model, chosen[k : k + BATCH])
        return model.odds()

    def step(self, model: Softmax, which: np.ndarray) -> None:
        """One update by some windows."""
        size = self.stop[which] - self.start[which]
        at = np.repeat(self.start[which] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        n = self.numbers[at]
        buckets, per_word = self.every.gather(n), self.every.count[n]
        window = np.repeat(np.repeat(np.arange(len(which)), size), per_word)
        share = np.repeat(1.0 / (WINDOW * per_word), per_word).astype(np.float32)
        model.step(buckets, window, share, self.label[self.text[which]])


class Softmax:
    """Embeddings of buckets and the softmax over their means, updated together with rates of their own (AdaGrad)."""

    def __init__(self, random: np.random.Generator):
        self.embed = random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.soft = random.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.g_embed, self.g_soft = np.full(BUCKETS, 1e-4, np.float32), 1e-2

    def odds(self) -> np.ndarray:
        return self.embed.astype(np.float64) @ (self.soft[:, 1] - self.soft[:, 0]).astype(np.float64)

    def step(self, bucket: np.ndarray, window: np.ndarray, weight: np.ndarray, y: np.ndarray) -> None:
        """Buckets of windows (ascending) with their weights; y: the windows' labels."""
        hidden = np.zeros((len(y), DIM), np.float32)
        full = np.flatnonzero(np.bincount(window, minlength=len(y)))
        if len(full):
            hidden[full] = np.add.reduceat(self.embed[bucket] * weight[:, None], np.searchsorted(window, full))
        out = hidden @ self.soft + self.bias
        p = np.exp(out - out.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        if len(bucket):
            order = np.argsort(bucket, kind="stable")
            own = bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            g = np.add.reduceat((p @ self.soft.T)[window[order]] * weight[order, None], cuts)
            rows = own[cuts]
            self.g_embed[rows] += (g * g).mean(1)
            self.embed[rows] -= RATE * g / np.sqrt(self.g_embed[rows])[:, None]
        d = hidden.T @ p / len(y)
        self.g_soft += float((d * d).mean())
        self.soft -= 0.1 * d / np.sqrt(self.g_soft)
        self.bias -= 0.1 * p.mean(0)


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by ridged Newton steps."""
    slope, intercept = 0.0, 0.0
    centre, spread = x.mean(), x.std() or 1.0
    z = (x - centre) / spread
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + intercept, -35, 35)))
        w, e = p * (1 - p), p - y
        g = np.array([z @ e + 0.01 * slope, e.sum()])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        slope, intercept = slope - float(np.clip(move[0], -2, 2)), intercept - float(np.clip(move[1], -2, 2))
    return slope / spread, intercept - slope * centre / spread


def _loaded(docs: DataFrame, model: tuple):
    """A function that gives a task its words, and the calibration."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # BUCKETS numbers
    return lambda: (kept(name, lambda: Words(shared.value[0])), *shared.value[1:])


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], key: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``key`` columns and the probability of label 1."""
    load = _loaded(docs, model)

    def make():
        words, slope, intercept = load()
        return lambda texts: [pa.array(1 / (1 + np.exp(-np.clip(slope * words.highest(texts) + intercept, -35, 35))))]

    return map_text(docs, key, text, f"{out} double", make, "arrow")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float, float], text: str = "text") -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    load = _loaded(docs, model)

    def make():
        words, slope, intercept = load()
        return lambda texts: slope * words.highest(texts) + intercept < 0

    return filter_text(docs, text, make)
