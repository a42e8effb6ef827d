"""Operator 7: token counts by a finite-state transducer compiled from a BPE tokenizer.

A piece (one match of the tokenizer's pattern) is read byte by byte. The last token
``t(i)`` of the encoding of the first ``i`` bytes is the only vocabulary entry ``w``
that ends there and whose pair ``(t(i - |w|), w)`` merges no further; the encoding of
the prefix has one token more than that of the first ``i - |w|`` bytes. So a state
need only hold, for each vocabulary prefix that ends at ``i``, the last token before it
and how many tokens fewer that position has. States are made when first reached
(lazy determinisation) and every transition is annotated with the tokens it adds; the
end of a piece is one more transition.

ASCII white space ends every piece, so the state map of a chunk between white space
sends each state to the start with a fixed count: chunks compose by a prefix sum. A long
piece is cut into blocks, whose state maps compose pairwise in a tree: a map is worked out
from the start state, and from another entry state when a composition asks for it, which joins
the run from the start within some bytes. Special strings count one and end the piece before
them, as in the library.

Null texts count as empty: zero tokens. Repeated rows and ids are counted alike; an empty table
gives an empty one. Columns that aren't named are left out; a ``key`` column may not be called
as an output column is.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from seqloom.llm.chunks import ChunkMemo, sums
from seqloom.llm.common import kept, map_text

#: Bytes in a block of a long piece.
BLOCK = 256


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    own = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of pieces."""

    def __init__(self, vocabulary: list[str], merges: list[tuple[str, str]], suffix: str, limit: int = 150_000):
        letters = byte_letters()
        self.limit = limit
        self.token: dict[tuple[bytes, bool], int] = {}
        self.spelled: list[tuple[bytes, bool]] = []
        number = {}
        for v in vocabulary:
            ends = bool(suffix) and v.endswith(suffix)
            body = v[: len(v) - len(suffix)] if ends else v
            if not body or any(c not in letters for c in body):
                continue
            key = (bytes(letters[c] for c in body), ends)
            if key not in self.token:
                self.token[key] = len(self.spelled)
                self.spelled.append(key)
            number[v] = self.token[key]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            if a in number and b in number and a + b in number:
                self.merge.setdefault((number[a], number[b]), (rank, number[a + b]))
        # The trie of all spellings, with failure links.
        self.child: list[dict[int, int]] = [{}]
        depth = [0]
        ids: list[list[int | None]] = [[None, None]]
        for n, (body, ends) in enumerate(self.spelled):
            at = 0
            for b in body:
                if b not in self.child[at]:
                    self.child[at][b] = len(self.child)
                    self.child.append({})
                    depth.append(depth[at] + 1)
                    ids.append([None, None])
                at = self.child[at][b]
            ids[at][ends] = n
        self.depth, self.ids, self.fail = depth, ids, [0] * len(depth)
        queue = list(self.child[0].values())
        for at in queue:
            for b, to in self.child[at].items():
                f = self.fail[at]
                while f and b not in self.child[f]:
                    f = self.fail[f]
                self.fail[to] = self.child[f].get(b, 0)
                queue.append(to)
        self.valid: dict[tuple[int | None, int], bool] = {}
        self.past: dict[int, tuple] = {}
        self.chains: dict[int, tuple] = {}
        self.suffix = bool(suffix)
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.end: list[int | None] = []
        self.start = self.state((0, ((None, 0),)))

    def state(self, key: tuple) -> int:
        n = self.states.get(key)
        if n is None:
            n = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
            self.end.append(None)
        return n

    def history(self, n: int) -> tuple[list[int], list[int], list[int], bool]:
        """An entry's own merges in order: their ranks, the left and right ends before each and after the last, and whether it comes out whole."""
        known = self.past.get(n)
        if known is None:
            body, ends = self.spelled[n]
            symbols = [self.token[bytes([b]), ends and i == len(body) - 1] for i, b in enumerate(body)]
            ranks, left, right = [], [symbols[0]], [symbols[-1]]
            while True:
                best = min(((self.merge[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.merge), default=None)
                if best is None:
                    break
                i = best[1]
                symbols[i : i + 2] = [self.merge[symbols[i], symbols[i + 1]][1]]
                ranks.append(best[0])
                left.append(symbols[0])
                right.append(symbols[-1])
            known = self.past[n] = (ranks, left, right, symbols == [n])
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge ever joins a and b: both run their own merges, the lowest rank (leftmost of equals) first."""
        (a_ranks, _, a_end, _), (b_ranks, b_end, _, _) = self.history(a), self.history(b)
        i, j, never = 0, 0, len(self.merge)
        while True:
            next_a = a_ranks[i] if i < len(a_ranks) else never
            next_b = b_ranks[j] if j < len(b_ranks) else never
            joint = self.merge.get((a_end[i], b_end[j]))
            if joint is not None and joint[0] < next_a and joint[0] <= next_b:
                return False
            if next_a == next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def follows(self, a: int | None, b: int) -> bool:
        """Whether b stays as it is after a (None: at the start)."""
        known = self.valid.get((a, b))
        if known is None:
            if len(self.valid) > 400_000:
                self.valid.clear()
            known = self.valid[a, b] = self.history(b)[3] and (a is None or self.apart(a, b))
        return known

    def chain(self, node: int) -> tuple[tuple[int, ...], tuple[tuple, ...]]:
        """Of a node and its failure links down to the root: depths, and (depth - 1, inner entry, last entry)."""
        known = self.chains.get(node)
        if known is None:
            nodes = [node]
            while nodes[-1]:
                nodes.append(self.fail[nodes[-1]])
            known = self.chains[node] = (tuple(self.depth[n] for n in nodes), tuple((self.depth[n] - 1, *self.ids[n]) for n in nodes[:-1]))
        return known

    def step(self, s: int, b: int) -> tuple[int, int]:
        """Make the transition from state s on byte b.

        A state holds, for each node of its chain, the last token before the node's
        spelling and that position's tokens less those of the present one.
        """
        node, held = self.keys[s]
        before = dict(zip(self.chain(node)[0], held))
        while node and b not in self.child[node]:
            node = self.fail[node]
        node = self.child[node].get(b, 0)
        links = self.chain(node)[1]
        for d, w, _ in links:
            if w is not None:
                last, less = before[d]
                if self.follows(last, w):
                    gain = less + 1
                    break
        else:
            raise ValueError("a byte has no token")
        new = [(before[d][0], before[d][1] - gain) for d, _, _ in links]
        new.append((w, 0))
        out = self.next[s][b] = (self.state((node, tuple(new))), gain)
        return out

    def finish(self, s: int) -> int:
        node, held = self.keys[s]
        if not self.suffix:
            self.end[s] = 0
            return 0
        for (_, _, w), (last, less) in zip(self.chain(node)[1], held):
            if w is not None and self.follows(last, w):
                self.end[s] = less + 1
                return less + 1
        raise ValueError("a piece has no last token")

    def run(self, s: int, data: bytes) -> tuple[int, int]:
        """The state after data, and the tokens it adds."""
        total, following = 0, self.next
        for b in data:
            hit = following[s].get(b)
            if hit is None:
                hit = self.step(s, b)
            s, gain = hit
            total += gain
        return s, total

    def count(self, piece: bytes) -> int:
        if len(self.keys) > self.limit:
            self.forget()
        if len(piece) <= 2 * BLOCK:
            s, n = self.run(self.start, piece)
        else:
            s, n = composed([BlockMap(self, piece[i : i + BLOCK]) for i in range(0, len(piece), BLOCK)]).at(self.start)
        end = self.end[s]
        return n + (self.finish(s) if end is None else end)


class BlockMap:
    """The state map of a block: exit state and tokens for each entry state.

    The run from the start state is kept whole; another entry state's run joins it within some bytes.
    """

    def __init__(self, machine: Transducer, data: bytes):
        self.machine, self.data = machine, data
        self.states, self.counts, s, n = [machine.start], [0], machine.start, 0
        for b in data:
            s, gain = machine.next[s].get(b) or machine.step(s, b)
            n += gain
            self.states.append(s)
            self.counts.append(n)

    def at(self, s: int) -> tuple[int, int]:
        n = 0
        for i, b in enumerate(self.data):
            if s == self.states[i]:
                return self.states[-1], n + self.counts[-1] - self.counts[i]
            s, gain = self.machine.next[s].get(b) or self.machine.step(s, b)
            n += gain
        return s, n


class Composed:
    """The map of two neighbouring parts of a piece, worked out for the entry states that are asked for."""

    def __init__(self, left: BlockMap | Composed, right: BlockMap | Composed, start: int):
        self.left, self.right, self.known = left, right, {}
        self.at(start)

    def at(self, s: int) -> tuple[int, int]:
        if s not in self.known:
            middle, n = self.left.at(s)
            end, more = self.right.at(middle)
            self.known[s] = end, n + more
        return self.known[s]


def composed(maps: list[BlockMap]) -> BlockMap | Composed:
    """One map of all blocks: neighbours are composed, then neighbouring pairs, and so on, as in a parallel prefix scan."""
    start = maps[0].machine.start
    while len(maps) > 1:
        pairs = [Composed(a, b, start) for a, b in zip(maps[::2], maps[1::2])]
        maps = pairs + maps[2 * len(pairs) :]
    return maps[0]


class Counts(dict):
    """Piece -> number of tokens, worked out when first asked for."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.count(piece.encode())
        return n


class TokenCounter:
    """Counts tokens of whole texts as the tokenizer file at ``path`` gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("not a tokenizer that this transducer knows")
        vocabulary = [v for v, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
        self.machine = Transducer(vocabulary, [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.lower: dict[str, str] = {}
        self.reset()
        self.memo = ChunkMemo(self.resolve, self.reset)

    def reset(self) -> None:
        self.tokens, self.pieces = np.empty(0, np.int32), Counts(self.machine.count)

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:  # str.lower() treats a last sigma apart; the tokenizer goes letter by letter
            return "".join(c.lower() for c in text)
        return text.lower()

    def chunk(self, text: str) -> int:
        n = 0
        parts = [text]
        if self.special and "<" in text:
            n += len(self.special.findall(text))
            parts = self.special.split(text)
        return n + sum(map(self.pieces.__getitem__, (p for part in parts for p in self.find(self.normal(part)))))

    def resolve(self, chunks: list[bytes]) -> None:
        new = np.fromiter((self.chunk(c.decode()) for c in chunks), np.int32, len(chunks))
        self.tokens = np.concatenate((self.tokens, new))

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        numbers, per_text = self.memo.of(texts)
        return sums(self.tokens[numbers].astype(np.int64), per_text)


def _counter(path: str) -> TokenCounter:
    return kept(f"fst {path}", lambda: TokenCounter(path))


def token_counts(docs: DataFrame, tokenizer_path: str, key: list[str], text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``key`` columns, the text's UTF-8 bytes (``n_bytes``) and its number of tokens."""

    def make():
        counter = _counter(tokenizer_path)
        return lambda texts: [pc.binary_length(texts).cast(pa.int64()), pa.array(counter.counts(texts), pa.int64())]

    return map_text(docs, key, text, f"n_bytes long, {out} long", make, "arrow")
