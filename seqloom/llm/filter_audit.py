"""Operator 13: how filters of documents interact.

Five filters, A to E, are applied in each of their 120 orders; the audit says for every order and step how many documents of
a part go, how many that fail were gone before, and what labelled documents are lost.

* A, too few words, and B, too few distinct ones, are read off a sparse document-term matrix. Tasks cut batches of texts
  into words and write them as CSR shards over the batch's own vocabulary. Vocabularies go to ``BUCKETS`` by a hash of the word,
  a shard's words of a bucket in one row; each bucket numbers its distinct words, one bucket at a time in a task's memory, and
  after those of the buckets before that is the global dictionary. The numbers go back to the shards, whose columns
  are recoded by them. The sums of a shard's rows are documents' words, the numbers of nonzeros their
  distinct words. A word is sent once for each shard that has it, however often it occurs there.
* C, too many capitals, D, odd signs, and SHA-256 of the text come from the same pass over the texts; E, a copy of a text
  with a lesser id, from the least id of each digest.

Documents are counted by part and by which filters they fail (32 patterns); all orders are worked out of those counts.

Null texts count as empty, null parts as the empty string. Every row counts as a document, repeated ones too; rows of one id and text
aren't copies of each other. Rows without an id are never copies nor what others are copies of, and have no labels. An
id labelled twice has a label if one of its rows has. An empty table gives an empty table. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import sized, stored

FILTERS = "ABCDE"
#: A: under so many words. B: distinct words under so many percent. C: capitals over so many percent. D: signs.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SIGNS, CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows and bytes of text of a shard of the matrix; a longer text is a shard of its own.
SHARD_ROWS, SHARD_BYTES = 16_384, 8 << 20
#: Shards of a file.
FILE_SHARDS = 4
#: Buckets of the dictionary, by crc32 of the word.
BUCKETS = 4096

_DOC = "doc_id bigint, part string, capitals boolean, signs boolean, digest binary"
_SHARD = f"shard bigint, docs array<struct<{_DOC.replace(' ', ':').replace(',:', ',')}>>, ends array<int>, columns array<int>, counts array<int>, vocabulary array<struct<bucket:int,first:int,words:binary>>"


def csr(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, bytes]]]:
    """Row ends, columns and counts of a document-term matrix, and (bucket, its first column, its words) of its columns, by bucket."""
    words = [t.split() for t in texts]  # at ASCII white space
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    bucket = np.fromiter(map(crc32, names), np.int64, len(names)) % BUCKETS
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    width = max(1, len(names))
    cells, counts = np.unique(np.repeat(np.arange(len(words)), sizes) * width + place[coded.indices.to_numpy()], return_counts=True)
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    groups = zip(starts.tolist(), np.append(starts[1:], len(names)).tolist())
    vocabulary = [(int(bucket[order[i]]), i, b" ".join(names[n] for n in order[i:j])) for i, j in groups]
    return np.searchsorted(cells, np.arange(len(words) + 1) * width), cells % width, counts, vocabulary


def _one(values: pa.Array) -> pa.ListArray:
    """All values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for b in sized(batches, 2, SHARD_ROWS, SHARD_BYTES):
        if not b.num_rows:
            continue
        texts = b.column(2).cast(pa.binary()).to_pylist()
        size = np.array([len(t) for t in texts])
        less = lambda signs: size - np.array([len(t.translate(None, signs)) for t in texts])
        points = pc.utf8_length(b.column(2)).to_numpy(zero_copy_only=False)
        flags = [pa.array(100 * less(CAPITALS) > CAPITAL_PERCENT * points), pa.array(less(SIGNS) > 0)]
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        docs = pa.StructArray.from_arrays([b.column(0), b.column(1), *flags, digests], ["doc_id", "part", "capitals", "signs", "digest"])
        ends, columns, counts, words = csr(texts)
        words = pa.StructArray.from_arrays([pa.array([w[i] for w in words], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "first", "words"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), _one(docs), *(_one(pa.array(x.astype(np.int32))) for x in (ends, columns, counts)), _one(words)],
            ["shard", "docs", "ends", "columns", "counts", "vocabulary"],
        )
        number += 1
    pa.default_memory_pool().release_unused()


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words inside their bucket; ``fresh`` are those that the bucket had not seen before, from number ``at`` on."""
    bucket, known = None, {}
    for b in batches:
        rows = []
        for of, own, first, words in zip(*(c.to_pylist() for c in b.columns)):
            if own != bucket:
                bucket, known = own, {}
            words, at = words.split(b" "), len(known)
            ranks = [known.setdefault(w, len(known)) for w in words]
            rows.append((of, own, first, ranks, at, [w for w, r in zip(words, ranks) if r >= at]))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["of", "bucket", "first", "ranks", "at", "fresh"])


def _matrix(shard: pa.Table, codes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ends, columns and counts of a shard over the global dictionary."""
    ends, local, counts = (shard[c].combine_chunks().flatten().to_numpy() for c in ("ends", "columns", "counts"))
    ranks = codes["ranks"].combine_chunks()
    sizes = np.diff(ranks.offsets.to_numpy())
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids = np.empty(sizes.sum(), np.int64)
    ids[np.repeat(codes["first"].to_numpy(), sizes) + within] = np.repeat(codes["upto"].to_numpy(), sizes) + ranks.flatten().to_numpy()
    return ends, ids[local], counts


def _measured(shard: pa.Table, codes: pa.Table) -> pa.Table:
    """The documents of a shard with the sum and the number of nonzeros of their rows."""
    ends, _, counts = _matrix(shard, codes)
    upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    docs = shard["docs"].combine_chunks().flatten()
    return pa.Table.from_arrays(
        [*docs.flatten(), pa.array(np.diff(upto[ends])), pa.array(np.diff(ends).astype(np.int64))],
        ["doc_id", "part", "capitals", "signs", "digest", "words", "distinct_words"],
    )


def _csr_table(shard: pa.Table, codes: pa.Table) -> pa.Table:
    docs = shard["docs"].combine_chunks().flatten().field("doc_id")
    return pa.Table.from_arrays([shard["shard"], _one(docs), *(_one(pa.array(x)) for x in _matrix(shard, codes))], ["shard", "doc_ids", "ends", "columns", "counts"])


def _coded(docs: DataFrame, key: str, text: str, part: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shards over their own vocabularies, the global dictionary, and (of, first, ranks, upto): the numbers of a shard's words of a bucket."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    shards = stored(rows.mapInArrow(_shards, _SHARD), "csr", FILE_SHARDS)
    words = shards.select(F.col("shard").alias("of"), F.inline("vocabulary")).repartition("bucket").sortWithinPartitions("bucket", "of")
    ranked = stored(words.mapInArrow(_ranks, "of bigint, bucket int, first int, ranks array<int>, at int, fresh array<binary>"), "dictionary")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    sizes = ranked.groupBy("bucket").agg(F.sum(F.size("fresh")).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("upto"))
    ranked = ranked.join(F.broadcast(sizes), "bucket")  # BUCKETS rows at most
    known = ranked.select(F.posexplode("fresh").alias("i", "word"), (F.col("upto") + F.col("at")).alias("id")).select("word", (F.col("id") + F.col("i")).alias("id"))
    return shards.drop("vocabulary"), known, ranked.select("of", "first", "ranks", "upto")


def document_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> tuple[DataFrame, DataFrame]:
    """The document-term matrix in CSR shards (shard, doc_ids, ends, columns, counts), and its dictionary (word, id), numbered from 0 without gaps."""
    shards, known, codes = _coded(docs, key, text, part)
    found = shards.groupBy("shard").cogroup(codes.groupBy("of")).applyInArrow(lambda a, b: _csr_table(a, b), "shard bigint, doc_ids array<bigint>, ends array<int>, columns array<bigint>, counts array<int>")
    return found, known


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, capitals, signs, digest, words, distinct_words) of every row."""
    shards, _, codes = _coded(docs, key, text, part)
    return shards.groupBy("shard").cogroup(codes.groupBy("of")).applyInArrow(lambda a, b: _measured(a, b), f"{_DOC}, words bigint, distinct_words bigint")


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, good, toxic) of every row: bit i of ``mask`` says that filter i fails."""
    at = stored(measured(docs, key, text, part), "measured")
    first = at.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col(quality) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic) == 1, F.lit(False))).alias("toxic"))
    at = at.join(first, "digest").join(marks, "doc_id", "left")
    fails = [
        F.col("words") < MIN_WORDS,
        100 * F.col("distinct_words") < DISTINCT_PERCENT * F.col("words"),
        F.col("capitals"),
        F.col("signs"),
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return at.select("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(failed: DataFrame) -> DataFrame:
    """One row a part, order and step, from ``failures``' rows."""
    counts = failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("p"))  # 32 at most
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    at = parts.select("part", "p", F.explode(F.array(*steps)).alias("s")).select("part", "p", "s.*")
    bit, before = F.col("bit"), F.col("before")
    hit, gone = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    total = lambda value, when: F.aggregate(F.filter("p", lambda x: when(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + value(x))
    n = lambda x: x["n"]
    removed = lambda m: hit(m) & ~gone(m)
    return at.select(
        "part", "filter_order", "step",
        total(n, lambda m: ~hit(m) & ~gone(m)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: hit(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m == bit).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        # Of the 120 orders, each of the filters that a document fails comes first among them in an equal share.
        total(lambda x: x["n"] * F.element_at(F.array(*(F.lit(120 // k) for k in range(1, 6))), F.bit_count(x["mask"]).cast("int")), hit).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders and steps of each part."""
    return audit(failures(docs, labels, **columns))
