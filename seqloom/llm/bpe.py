"""Operator 1: byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; every match is merged on its own. The
merges of a piece run over a segment tree on its byte positions. A leaf holds the
rank of the pair that starts there, inner nodes the least (rank, position) below, so
the root is the leftmost pair of least rank. A merge changes three leaves: the merged
token's, its live left neighbour's, and the one that died; each costs a path to the
root. Short pieces are merged in lockstep, one tree a row of a matrix; long ones one
by one, in O(n log n).

Null texts count as empty: no ids, empty decoded bytes. Other columns pass through
only if named. Repeated rows are encoded alike; an empty table gives an empty table.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqloom.llm.chunks import ChunkMemo, Ragged, flat
from seqloom.llm.common import kept, map_text

NONE = np.iinfo(np.int64).max
#: Pieces of up to so many bytes are merged in lockstep.
LOCKSTEP = 64
#: Marks a text's first chunk, which has no blank before it. No later chunk starts with it but after a blank.
START = "\ud800"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairRanks:
    """(left id, right id) -> id of the merged token; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.one = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ids = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.keys = np.append(self.keys, NONE)
        self.ids = np.append(self.ids, -1)

    def many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, -1 where a pair doesn't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], -1)


def merge_one(piece: bytes, first: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge one piece over a segment tree of (rank, position) keys."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    token = [first[b] for b in piece]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    none = 1 << 62
    tree = [none] * (2 * width)

    def key(i: int) -> int:
        j = right[i]
        rank = pairs.get(token[i] << 32 | token[j]) if j < n else None
        return none if rank is None else rank * width + i

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    for i in range(n - 1):
        tree[width + i] = key(i)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        gone = right[i]
        token[i], right[i] = rank, right[gone]
        if right[gone] < n:
            left[right[gone]] = i
        put(gone, none)
        put(i, key(i))
        if left[i] >= 0:
            put(left[i], key(left[i]))
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = right[i]
    return out


def merge_many(pieces: list[bytes], first: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merge pieces of like width in lockstep; returns ids in a row and counts."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << max(1, int(size.max() - 1).bit_length())
    rows, cols = len(pieces), np.arange(width)
    live = cols < size[:, None]
    token = np.zeros((rows, width), np.int64)
    token[live] = first[np.frombuffer(b"".join(pieces), np.uint8)]
    left = np.tile(cols - 1, (rows, 1))
    right = np.tile(cols + 1, (rows, 1))
    tree = np.full((rows, 2 * width), NONE, np.int64)
    r, i = np.nonzero(live[:, 1:])
    rank = pairs.many(token[r, i], token[r, i + 1])
    tree[r, width + i] = np.where(rank >= 0, rank * width + i, NONE)
    for k in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
        k = i + width
        tree[r, k] = value
        while k[0] > 1:  # all leaves are equally deep
            k = k >> 1
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    def rekey(r: np.ndarray, i: np.ndarray) -> None:
        j = right[r, i]
        there = j < size[r]
        rank = np.where(there, pairs.many(token[r, i], token[r, np.where(there, j, 0)]), -1)
        put(r, i, np.where(rank >= 0, rank * width + i, NONE))

    r = np.flatnonzero(tree[:, 1] < NONE)
    while len(r):
        rank, i = np.divmod(tree[r, 1], width)
        gone = right[r, i]
        after = right[r, gone]
        token[r, i], right[r, i], live[r, gone] = rank, after, False
        inside = after < size[r]
        left[r[inside], after[inside]] = i[inside]
        put(r, gone, NONE)
        rekey(r, i)
        before = left[r, i]
        has = before >= 0
        if has.any():
            rekey(r[has], before[has])
        r = r[tree[r, 1] < NONE]
    return token[live], live.sum(1)


class ByteBpe:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pairs = PairRanks(ranks)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        # Before a blank that a non-blank follows a new match always begins.
        self.odd, self.cut = regex.compile(r" (?=\s|$)"), regex.compile(r" (?=\S)")
        self.reset()
        self.memo = ChunkMemo(self.resolve, self.reset)

    def reset(self) -> None:
        self.rows = Ragged()

    def pieces_to_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done: dict[int, list[int]] = {}
        classes: dict[int, list[int]] = {}
        for n, p in enumerate(pieces):
            known = self.ranks.get(p)
            if known is not None:
                done[n] = [known]
            elif len(p) > LOCKSTEP:
                done[n] = merge_one(p, self.first.tolist(), self.pairs.one)
            else:
                classes.setdefault((len(p) - 1).bit_length(), []).append(n)
        for members in classes.values():
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                ids, counts = merge_many([pieces[n] for n in part], self.first, self.pairs)
                ids, end = ids.tolist(), 0
                for n, c in zip(part, counts.tolist()):
                    done[n] = ids[end : end + c]
                    end += c
        return flat(done[n] for n in range(len(pieces)))

    def resolve(self, chunks: list[str]) -> None:
        find, number, parts = self.find, {}, []
        for c in chunks:
            c = c[1:] if c[:1] == START else " " + c
            parts.append([number.setdefault(p, len(number)) for p in find(c)])
        ids = Ragged()
        ids.extend(*self.pieces_to_ids([p.encode() for p in number]))
        rows, counts = flat(parts, np.int64)
        lengths = ids.count[rows].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        at = np.concatenate(([0], np.cumsum(counts)))
        self.rows.extend(ids.gather(rows), np.diff(ends[at]))

    def chunks(self, text: str) -> list[str]:
        """Parts of the text that match apart; a blank goes before each part but the first."""
        parts = self.cut.split(text) if self.odd.search(text) else text.split(" ")
        parts[0] = START + parts[0]
        return parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's ids."""
        numbers, counts = self.memo.numbers([self.chunks(t) for t in texts])
        ids = self.rows.gather(numbers)
        ends = np.concatenate(([0], np.cumsum(self.rows.count[numbers].astype(np.int64))))
        at = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(ends[at])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def _coder(path: str, pattern: str) -> ByteBpe:
    return kept(f"bpe {path} {pattern}", lambda: ByteBpe(load_ranks(path), pattern))


def byte_bpe(
    docs: DataFrame, ranks_path: str, pattern: str, key: list[str], text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``key`` columns, the token ids of each text, and (if named) the bytes they decode to.

    ``ranks_path`` is a rank file that every executor can open, as installed packages are.
    """

    def make():
        coder = _coder(ranks_path, pattern)

        def run(texts: list[str]) -> list:
            flat_ids, counts = coder.encode(texts)
            ends = np.concatenate(([0], np.cumsum(counts)))
            out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat_ids, pa.int32()))]
            if decoded:
                out.append(pa.array([coder.decode(flat_ids[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()))
            return out

        return run

    return map_text(docs, key, text, f"{ids} array<int>" + f", {decoded} binary" * bool(decoded), make)
