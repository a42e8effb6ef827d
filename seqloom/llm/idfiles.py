"""Operator 4: token ids in bit-packed binary files.

File format (little-endian): magic; blocks of ``BLOCK`` ids, each id in the fewest bits
that hold the vocabulary, each block from a whole byte; then a footer of four int64
arrays - document ids, each document's number of ids, block offsets, and
(bits, ids, documents, blocks) - and the magic again. Ids run through documents
without gaps, so id ``k`` is in block ``k // BLOCK`` at bit ``k % BLOCK * bits``: any
range of ids is found through the block offsets and unpacked with numpy.

Every task writes the file of its range of document ids under a temporary name and
renames it when whole: a repeated task replaces it with the same bytes. Null texts
count as empty, so a document always has its end id. Documents of one id are in the
order of their texts. Documents without an id come first; the files hold the least int64
for theirs, which reading gives back as null. An empty table gives no files and no rows.
Other columns are left out, whatever their names.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.chunks import ChunkMemo, Ragged, flat, sums
from seqloom.llm.common import kept, scratch, sized

MAGIC = b"SQLMIDS1"
BLOCK = 8192
#: Stands for a document's missing id.
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits)) & 1 == 1, bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.int64)
    ones = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return ones.reshape(count, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


class Writer:
    """Writes one file; ids of a document may come in any number of parts."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.rest, self.docs, self.counts, self.offsets, self.total = np.empty(0, np.int64), [], [], [], 0
        out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: list[int], counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(docs, np.int64))
        self.counts.append(np.asarray(counts, np.int64))
        self.total += len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(ids[k : k + BLOCK])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        docs, counts = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.docs, self.counts))
        for a in (docs, counts, np.array(self.offsets, np.int64), np.array([self.bits, self.total, len(docs), len(self.offsets)], np.int64)):
            self.out.write(a.astype("<i8").tobytes())
        self.out.write(MAGIC)


class Reader:
    """Reads one file: the documents, and any range of ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._read(size - 40, 40)
        if tail[32:] != MAGIC:
            raise ValueError("not an id file")
        self.bits, self.total, docs, blocks = np.frombuffer(tail[:32], "<i8").tolist()
        foot = np.frombuffer(self._read(size - 40 - 8 * (2 * docs + blocks), 8 * (2 * docs + blocks)), "<i8")
        self.docs, self.counts, self.offsets = foot[:docs], foot[docs : 2 * docs], foot[2 * docs :]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (excluded) of the file."""
        if start >= stop:
            return np.empty(0, np.int64)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        ids = min(self.total, (last + 1) * BLOCK) - first * BLOCK
        data = self._read(int(self.offsets[first]), (ids * self.bits + 7) // 8)  # whole blocks end on a byte
        return unpack(data, ids, self.bits)[start - first * BLOCK : stop - first * BLOCK]


#: Signs that, at the end of a word after a letter or digit, are a piece of their own to the tokenizer.
_SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
#: Stands between pieces that are encoded in one call; the library gives it an id of its own.
_BETWEEN = "<|startoftext|>"


def pieces(words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Parts of words that the tokenizer treats apart, in a row, and how many each word has; the parts' ids are the words'."""
    plain = pc.invert(pc.match_substring(words, "<|"))  # others may hold a special string
    lower = pc.if_else(pc.and_(plain, pc.string_is_ascii(words)), pc.ascii_lower(words), words)  # the library's next step
    core = pc.ascii_rtrim(lower, characters=_SIGNS)
    cut = pc.and_(pc.and_(plain, pc.less(pc.binary_length(core), pc.binary_length(lower))), pc.match_substring_regex(core, "[0-9A-Za-z]$"))
    core = pc.if_else(cut, core, lower)
    # Both parts' bytes are the word's: only offsets are added.
    counts = 1 + cut.to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.cumsum(counts) - 1
    size = np.zeros(int(counts.sum()), np.int32)
    whole, own = (pc.binary_length(x).to_numpy() for x in (lower, core))
    size[last - counts + 1] = own
    size[last[counts == 2]] = (whole - own)[counts == 2]
    lower = pa.concat_arrays([lower])
    start = np.frombuffer(lower.buffers()[1], np.int32, len(lower) + 1, 4 * lower.offset)[0] if len(lower) else 0
    ends = np.concatenate(([start], start + np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), lower.buffers()[2]), counts


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library.

    No token of this kind of tokenizer reaches over ASCII white space, which it drops,
    and nothing it does to a word depends on the words around it; so each distinct
    piece of a word of a batch is encoded by the library once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.between = self.tokenizer.token_to_id(_BETWEEN)
        self.reset()
        self.memo = ChunkMemo(self.resolve, self.reset, limit=900_000, limit_bytes=24 << 20)

    def reset(self) -> None:
        self.rows = Ragged()
        self.parts = Ragged()
        self.piece = ChunkMemo(self.spell, lambda: None, limit=1 << 62, limit_bytes=1 << 62)  # emptied with the words

    def spell(self, new: list[bytes]) -> None:
        """Encode pieces, many in one call, with a special string between them."""
        for at in range(0, len(new), 16_384):
            some = [p.decode() for p in new[at : at + 16_384]]
            own = {n: self.ids(p) for n, p in enumerate(some) if "<|" in p or self.between is None}
            ids = np.array(self.ids(_BETWEEN.join("" if n in own else p for n, p in enumerate(some))) if self.between else [], np.int32)
            gap = ids == self.between
            counts = np.diff(np.flatnonzero(np.concatenate(([True], gap, [True])))) - 1 if self.between else np.zeros(len(some), np.int64)
            ids = ids[~gap]
            if own:
                starts = np.cumsum(counts) - counts
                ids = np.insert(ids, np.repeat(starts[list(own)], [len(x) for x in own.values()]), [i for x in own.values() for i in x])
                counts[list(own)] = [len(x) for x in own.values()]
            self.parts.extend(ids, counts)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def resolve(self, chunks: list[bytes]) -> None:
        found, counts = pieces(pa.array(chunks, pa.binary()).cast(pa.string()))
        found = found.dictionary_encode()
        numbers = self.piece.distinct(found.dictionary.cast(pa.binary()).to_pylist())[found.indices.to_numpy()]
        self.rows.extend(self.parts.gather(numbers), sums(self.parts.count[numbers].astype(np.int64), counts))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        numbers, counts = self.memo.of(texts)
        return self.rows.gather(numbers), sums(self.rows.count[numbers].astype(np.int64), counts)


def _encoder(path: str) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(f"ids {path}", lambda: LibraryEncoder(path))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> list[tuple]:
    """Write the files of all documents in ascending ``key`` order; returns (path, ids, documents) of each, in order.

    The list has one entry a file, and there are as many files as shuffle partitions.
    """
    schema = "part int, path string, ids long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encoder = None, _encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        for b in sized(batches, 1):
            if writer is None:
                store, root = _open(folder)
                store.create_dir(root, recursive=True)
                temporary = f"{root}/.{uuid.uuid4().hex}"
                writer = Writer(store.open_output_stream(temporary), bits_for(max(encoder.vocabulary, end_id + 1)))
            ids, counts = encoder.encode(b.column(1))
            ends = np.cumsum(counts)
            writer.add(b.column(0).to_pylist(), counts + 1, np.insert(ids.astype(np.int64), ends, end_id))
        if writer is not None:
            writer.close()
            writer.out.close()
            path = f"{root}/part-{part:06d}.ids"
            store.move(temporary, path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "ids": [writer.total], "docs": [sum(map(len, writer.docs))]})

    rows = (
        docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", "text")
        .mapInArrow(run, schema)
        .collect()
    )
    return [(r.path, r.ids, r.docs) for r in sorted(rows, key=lambda r: r.part)]


def read_ids(spark: SparkSession, folder: str, files: list[tuple], key: str = "doc_id") -> DataFrame:
    """Documents as the files hold them: key, ``start`` among all ids, ``n_tokens``, ``ids``' crc32."""
    starts = np.concatenate(([0], np.cumsum([f[1] for f in files]))).tolist()
    listed = spark.createDataFrame([(f[0], s) for f, s in zip(files, starts)], "path string, start long")
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(path) as f:
                    r = Reader(f)
                    ends = np.cumsum(r.counts)
                    for at in range(0, len(r.docs), 512):  # some documents at a time
                        d, n, e = r.docs[at : at + 512], r.counts[at : at + 512], ends[at : at + 512]
                        first = int(e[0] - n[0])
                        raw = memoryview(r.ids(first, int(e[-1])).astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (a - first) : 4 * (z - first)]) for a, z in zip((e - n).tolist(), e.tolist())]
                        yield pa.RecordBatch.from_pydict({key: pa.array(d, mask=d == NO_ID), "start": start + e - n, "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})

    return listed.repartition(max(1, len(files))).mapInArrow(run, schema)


def packed_ids(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids, then read the files back."""
    folder = scratch(docs.sparkSession, "ids")
    return read_ids(docs.sparkSession, folder, write_ids(docs, tokenizer_path, end_id, folder, key, text), key)


def in_memory(ids: list[list[int]], bits: int) -> io.BytesIO:
    """A file of small lists, for tests."""
    out = io.BytesIO()
    w = Writer(out, bits)
    w.add(list(range(len(ids))), np.array([len(x) for x in ids]), np.array([x for r in ids for x in r], np.int64))
    w.close()
    return out
