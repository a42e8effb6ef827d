"""Operator 5: language-model scoring by prediction by partial matching.

Tokens are words (bytes other than ASCII white space, A-Z lower-cased) and one end a
document. A text becomes the bytes of its words, a stop after each, and an end symbol.
The model predicts these one by one from a trie of byte contexts of up to ``ORDER``
bytes, over words too. A symbol that the longest known context has not seen escapes to
the next shorter one: each distinct symbol of a context gives half of its first count to the
escape (method D). Shorter contexts count a symbol once for each context one byte longer that it
was seen in, as only what a longer context hasn't seen ever asks them. Symbols that the longer
context holds are excluded there; below the empty context all other symbols are equally
likely. Every context's symbols are also its shorter contexts', so exclusion takes from a
context's totals just the longer one's symbols: numbers that each node of the trie keeps.

What is gathered from the corpus: the counts of all distinct words, for the base score
(add-one-half unigrams), and of all of the trie's longest paths. A trie of at most ``PATHS``
paths is sent to the tasks. A larger one stays in Spark: tasks get the logs of its most
frequent paths, at most ``PATHS``, and pass on the other paths of each row, whose logs
come from joins with the levels of the trie; the scores are the same. Words that occur most - at most ``HOT`` - are looked up where the texts are
read; all others are joined by a shuffle, in which therefore no key is hot.

Null texts count as empty: just the end. Repeated rows are rows of their own, and so are rows
without an id; a null ``train`` is no training row. With no training rows every count is 0, the
base score is log10(1) a token and all symbols are equally likely. An empty table gives an empty
result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.chunks import sums, words
from seqloom.llm.common import kept, sized, stored

ORDER = 5
PATHS = 3_000_000
HOT = 150_000
#: Distinct entries that a task counts before it passes them on.
FLUSH = 250_000
#: Bytes that no word has: what stands before a text, after a word, and at the end.
BEGIN, STOP, END = 0x0A, 0x20, 0x0B
SYMBOLS = 258
#: What a frequent word's entry is for other words: known, base score, whether it is frequent.
_RARE = 0, 0.0, False
#: Bytes of texts worked on at a time.
PIECE = 1 << 20

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END_TOKEN = bytes([END])


def tokens(text: bytes) -> list[bytes]:
    """The words; the end is not among them."""
    return text.translate(_FOLD).split()


def stream(words: list[bytes], order: int) -> bytes:
    """A text as the model reads it; the first ``order`` bytes are context only."""
    return b"".join((bytes([BEGIN]) * order, b" ".join(words), b" " if words else b"", END_TOKEN))


def streams(texts: pa.StringArray, order: int) -> list[bytes]:
    """All texts as the model reads them."""
    joined = pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts))), " ").cast(pa.binary()).to_pylist()
    begin, end = bytes([BEGIN]) * order, bytes([STOP, END])
    return [begin + t + end if t else begin + END_TOKEN for t in joined]


def path_codes(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol at each predicted place of all streams, as numbers, and how many places each has."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    n = max(0, len(data) - order)
    code = np.zeros(n, np.int64)
    for k in range(order + 1):
        code <<= 8
        code |= data[k : k + n]
    inside = np.ones(n, bool)
    for cut in np.cumsum(sizes)[:-1].tolist():
        inside[cut - order : cut] = False
    return code[inside], sizes - order


def _totals(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their sums and how many rows each had."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n, np.diff(np.append(first, len(key)))


class Table:
    """Number -> value by open addressing, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(1.5 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; nan for what isn't there."""
        at = self.slot(keys)
        held = self.keys[at]
        out = self.values[at].astype(np.float64)
        wrong = np.flatnonzero(held != keys)
        while len(wrong):
            gone = held[wrong] == -1
            out[wrong[gone]] = np.nan
            wrong = wrong[~gone]
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            held[wrong] = self.keys[at[wrong]]
            hit = held[wrong] == keys[wrong]
            out[wrong[hit]] = self.values[at[wrong[hit]]]
            wrong = wrong[~hit]
        return out


class Ppm:
    """The trie, by levels: level k has the paths of k context bytes and a symbol."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.paths, self.counts, self.contexts = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
        total, kinds = [None] * (order + 1), [None] * (order + 1)
        for k in range(order, -1, -1):
            codes, summed, longer = _totals(codes & ((1 << 8 * (k + 1)) - 1), counts)
            counts = summed if k == order else longer
            self.paths[k], self.counts[k] = codes, counts
            self.contexts[k], total[k], kinds[k] = _totals(codes >> 8, counts)
        own = np.searchsorted(self.contexts[order], self.paths[order] >> 8)
        top = np.log10((2 * self.counts[order] - 1) / (2 * total[order])[own]) if len(own) else np.empty(0)
        self.top = Table(self.paths[order], top)
        self.leave = [np.log10(d / (2 * t)) for t, d in zip(total, kinds)]  # escape from a context met first
        self.whole, self.on = [None] * (order + 1), [None] * (order + 1)  # one level below it: log of the total, escape
        for k in range(1, order + 1):
            shorter = np.searchsorted(self.paths[k - 1], self.paths[k] & ((1 << 8 * k) - 1))
            first = np.searchsorted(self.paths[k] >> 8, self.contexts[k])
            excluded = np.add.reduceat(self.counts[k - 1][shorter], first) if len(first) else np.empty(0)
            below = np.searchsorted(self.contexts[k - 1], self.contexts[k] & ((1 << 8 * (k - 1)) - 1))
            t, d = total[k - 1][below] - excluded, kinds[k - 1][below] - kinds[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                self.whole[k] = np.log10(2 * t)
                self.on[k] = np.where(d > 0, np.log10(d / (2 * t)), 0.0)
        self.rest = float(np.log10(max(1, SYMBOLS - len(self.paths[0]))))
        self.paths[order] = self.counts[order] = np.empty(0, np.int64)  # the table has them

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def escaped(self, codes: np.ndarray) -> np.ndarray:
        """log10 probabilities of paths that the longest level doesn't hold."""
        out = np.zeros(len(codes))
        open_, above = np.ones(len(codes), bool), np.full(len(codes), -1, np.int64)  # above: place of the longer context
        for k in range(self.order, -1, -1):
            i = np.flatnonzero(open_)
            at, seen = self._find(self.paths[k], codes[i] & ((1 << 8 * (k + 1)) - 1))
            context, known = self._find(self.contexts[k], (codes[i] >> 8) & ((1 << 8 * k) - 1))
            started = above[i] >= 0
            if k < self.order:
                a = above[i]
                hit = i[seen & started]
                out[hit] += np.log10(2 * self.counts[k][at[seen & started]] - 1) - self.whole[k + 1][a[seen & started]]
                out[i[~seen & started]] += self.on[k + 1][a[~seen & started]]
            fresh = seen & ~started
            if fresh.any():  # the first context known has the symbol
                c = self.counts[k][at[fresh]]
                out[i[fresh]] += np.log10(2 * c - 1) - self._size(k, context[fresh])
            begin = known & ~seen & ~started
            out[i[begin]] += self.leave[k][context[begin]]
            above[i] = np.where(known, context, above[i])
            open_[i[seen]] = False
        out[open_] -= self.rest
        return out

    def _size(self, k: int, context: np.ndarray) -> np.ndarray:
        first = np.searchsorted(self.paths[k] >> 8, self.contexts[k])
        return np.log10(2 * np.add.reduceat(self.counts[k], first)[context])

    def logs(self, codes: np.ndarray) -> np.ndarray:
        out = self.top.get(codes)
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            distinct, back = np.unique(codes[new], return_inverse=True)
            out[new] = self.escaped(distinct)[back]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text's stream."""
        codes, n = path_codes(texts, self.order)
        return sums(self.logs(codes), n)


def vocabulary(docs: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """(word, c, n): counts of each distinct token in training texts and in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, whole = Counter(), Counter()

        def out():
            keys = list(whole)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                c, n = (np.fromiter((x[k] for k in part), np.int64, len(part)) for x in (learnt, whole))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(c), pa.array(n)], ["word", "c", "n"])
            learnt.clear()
            whole.clear()

        for b in sized(batches, 0):
            learn = b.column(1).to_numpy(zero_copy_only=False)
            found, index, counts = words(pc.ascii_lower(b.column(0)))
            for k, n in zip(found, np.bincount(index, minlength=len(found)).tolist()):
                whole[k] += n
            own = np.bincount(index[np.repeat(learn, counts)], minlength=len(found))
            for k in np.flatnonzero(own).tolist():
                learnt[found[k]] += int(own[k])
            whole[END_TOKEN] += b.num_rows
            learnt[END_TOKEN] += int(learn.sum())
            if len(whole) > FLUSH:
                yield from out()
        yield from out()

    return _texts(docs, text, train).mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _texts(docs: DataFrame, text: str, train: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))


def trie(docs: DataFrame, train: Column, order: int, text: str = "text") -> DataFrame:
    """(path, n): counts of the longest paths of the training texts, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            codes, counts, _ = _totals(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
            held[:] = [(codes, counts)]

        def out():
            fold()
            codes, counts = held.pop()
            for at in range(0, len(codes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 50_000]), pa.array(counts[at : at + 50_000])], ["path", "n"])

        for b in sized(batches, 0, size=PIECE):
            codes, _ = path_codes(streams(b.column(0), order), order)
            held.append(np.unique(codes, return_counts=True))
            if len(held) > 8:
                fold()
                if len(held[0][0]) > 4 * FLUSH:
                    yield from out()
        if held:
            yield from out()

    return _texts(docs, text, train).where("train").mapInArrow(run, "path long, n long").groupBy("path").agg(F.sum("n").alias("n"))


class Frequent:
    """The logs of some paths; what else texts have is passed on."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.table = Table(codes, logs)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The known paths' part of each text's score; text, path and times of the others."""
        codes, n = path_codes(texts, ORDER)
        out = self.table.get(codes)
        gone = np.isnan(out)
        out[gone] = 0.0
        bits = 8 * (ORDER + 1)
        other, times = np.unique(np.repeat(np.arange(len(n)), n)[gone] << bits | codes[gone], return_counts=True)
        return sums(out, n), other >> bits, other & ((1 << bits) - 1), times


def levels(counted: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of each level of the trie, (path, c) and of its contexts (x, t, d, whole, on): see ``Ppm``. Low levels are broadcast: their keys are few."""
    paths = [counted.select("path", F.col("n").alias("c"))]
    for k in range(order - 1, -1, -1):
        paths.insert(0, stored(paths[0].groupBy(_tail("path", k + 1).alias("path")).agg(F.count(F.lit(1)).alias("c")), f"ppm-level{k}"))
    contexts: list[DataFrame] = []
    for k, own in enumerate(paths):
        at = own.groupBy(F.shiftright("path", 8).alias("x")).agg(F.sum("c").alias("t"), F.count("*").alias("d"))
        if not k:
            at = at.withColumn("whole", F.lit(None).cast("double")).withColumn("on", F.lit(None).cast("double"))
        else:
            shorter = paths[k - 1].select(F.col("path").alias("short"), F.col("c").alias("less"))
            gone = own.withColumn("short", _tail("path", k)).join(shorter, "short").groupBy(F.shiftright("path", 8).alias("x")).agg(F.sum("less").alias("less"))
            below = contexts[-1].select(F.col("x").alias("y"), F.col("t").alias("bt"), F.col("d").alias("bd"))
            at = at.join(gone, "x").withColumn("y", _tail("x", k - 1)).join(below, "y")
            t, d = F.col("bt") - F.col("less"), F.col("bd") - F.col("d")
            on = F.when(d > 0, F.log10(d / (2 * t))).otherwise(0.0)
            at = at.select("x", "t", "d", F.when(t > 0, F.log10(2 * t)).alias("whole"), on.alias("on"))
        at = stored(at, f"ppm-contexts{k}")
        contexts.append(F.broadcast(at) if k < 3 else at)
    return [F.broadcast(p) if k < 2 else p for k, p in enumerate(paths)], contexts


def _tail(name: str, size: int) -> Column:
    return F.col(name).bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


def path_logs(codes: DataFrame, trie_levels: tuple[list[DataFrame], list[DataFrame]]) -> DataFrame:
    """(path, log) of distinct longest paths (path), in the trie or not."""
    paths, contexts = trie_levels
    out = codes.withColumn("context", F.shiftright("path", 8))
    for k, (own, at) in enumerate(zip(paths, contexts)):
        out = out.withColumn("p", _tail("path", k + 1)).join(own.select(F.col("path").alias("p"), F.col("c").alias(f"c{k}")), "p", "left").drop("p")
        about = at.select("x", *(F.col(c).alias(f"{c}{k}") for c in ("t", "d", "whole", "on")))
        out = out.withColumn("x", _tail("context", k)).join(about, "x", "left").drop("x")
    rest = -float(np.log10(max(1, SYMBOLS - paths[0].count())))
    on, fresh = F.lit(rest), F.lit(rest)  # the log from this level on, below a known context and with none known yet
    for k in range(len(paths)):
        c, t, d = F.col(f"c{k}"), F.col(f"t{k}"), F.col(f"d{k}")
        first = F.when(c.isNotNull(), F.log10((2 * c - 1) / (2 * t))).otherwise(F.log10(d / (2 * t)) + on)
        fresh = F.when(t.isNull(), fresh).otherwise(first)
        if k + 1 < len(paths):
            on = F.when(c.isNotNull(), F.log10(2 * c - 1) - F.col(f"whole{k + 1}")).otherwise(F.col(f"on{k + 1}") + on)
            out = out.withColumn(f"l{k}", on).withColumn(f"f{k}", fresh)
            on, fresh = F.col(f"l{k}"), F.col(f"f{k}")
    return out.select("path", fresh.alias("log"))


def _based(vocab: DataFrame, total: int, distinct: int) -> DataFrame:
    """(word, n, known, base) of each distinct token."""
    base = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    return vocab.select("word", "n", (F.col("c") > 0).cast("long").alias("known"), base.alias("base"))


def _hot(scored: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``: those from the least power of 2 ** (1/8) on that few enough reach."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 8)
    bins = sorted(((r.size, r["count"]) for r in scored.groupBy(size.alias("size")).count().collect()), reverse=True)
    least, held = None, 0
    for at, n in bins:  # at most 8 * 63 of them
        if held + n > most:
            break
        least, held = at, held + n
    return scored.where(size >= least) if least is not None else scored.limit(0)


def score_texts(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", most: int = PATHS) -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    spark = docs.sparkSession
    vocab = stored(vocabulary(docs, train, text), "ppm-words")
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    based = _based(vocab, total, distinct)
    hot = _hot(based, HOT).toArrow()
    frequent = dict(zip(hot["word"].to_pylist(), zip(hot["known"].to_pylist(), hot["base"].to_pylist(), [True] * len(hot))))
    counted = stored(trie(docs, train, ORDER, text), "ppm-paths")
    whole = counted.count() <= most
    if whole:
        rows, trie_levels = counted.toArrow(), None
        held = (rows["path"].to_numpy(), rows["n"].to_numpy(), ORDER)
    else:
        trie_levels = levels(counted)
        rows = path_logs(_hot(counted, most).select("path"), trie_levels).toArrow()
        held = (rows["path"].to_numpy(), rows["log"].to_numpy())
    shared = spark.sparkContext.broadcast((frequent, held))  # HOT words and ``most`` paths at most
    name = uuid.uuid4().hex
    schema = "row long, id long, word binary, n long, known long, base double, ppm double, path long"
    fields = ["row", "id", "word", "n", "known", "base", "ppm", "path"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def batch(columns: list, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(rows, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, model = shared.value[0], kept(name, lambda: (Ppm if whole else Frequent)(*shared.value[1]))
        row = TaskContext.get().partitionId() << 40
        for b in sized(batches, 1, size=PIECE):
            found, index, counts = words(pc.ascii_lower(b.column(1)))
            rows = np.arange(row, row + b.num_rows)
            row += b.num_rows
            known, base, hit = (np.array(x, t) for x, t in zip(zip(*(near.get(w, _RARE) for w in [*found, END_TOKEN])), (np.int64, float, bool)))
            own = [sums(x[index], counts) + hit[-1] * x[-1] for x in (known, base)]
            texts = np.repeat(np.arange(len(rows)), counts)[~hit[index]]
            rare, times = np.unique(texts * len(found) + index[~hit[index]], return_counts=True)
            scores = model.score(streams(b.column(1), ORDER))
            if not whole:
                scores, at, path, often = scores
                if len(at):
                    yield batch([rows[at], None, None, often, None, None, None, path], len(at))
            yield batch([rows, b.column(0), None, counts + 1, *own, scores, None], len(rows))
            if len(rare):
                text, word = np.divmod(rare, len(found))
                yield batch([rows[text], None, pa.array(found, pa.binary()).take(pa.array(word)), times, None, None, None, None], len(rare))
            if not hit[-1]:  # the end is no frequent word
                yield batch([rows, None, [END_TOKEN] * len(rows), np.ones(len(rows), np.int64), None, None, None, None], len(rows))

    read = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bags = stored(read.mapInArrow(run, schema), "ppm-bags")
    rare = bags.where("word is not null").select("row", "word", F.col("n").alias("times")).join(based.drop("n"), "word").select(
        "row",
        F.lit(None).cast("long").alias("id"),
        F.lit(0).cast("long").alias("n"),
        (F.col("times") * F.col("known")).alias("known"),
        (F.col("times") * F.col("base")).alias("base"),
        F.lit(0.0).alias("ppm"),
    )
    rows = bags.where("word is null and path is null").select("row", "id", "n", "known", "base", "ppm").unionByName(rare)
    if not whole:
        other = bags.where("path is not null").select("row", "path", F.col("n").alias("times"))
        logs = stored(path_logs(other.select("path").distinct(), trie_levels), "ppm-logs")
        none = {"id": None, "n": 0, "known": 0}
        part = other.join(logs, "path").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("ppm"))
        rows = rows.unionByName(part.select("row", *(F.lit(v).cast("long").alias(c) for c, v in none.items()), F.lit(0.0).alias("base"), "ppm"))
    return rows.groupBy("row").agg(
        F.max("id").alias(key),
        F.sum("n").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("ppm").alias("score"),
    ).select(key, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
