"""Operator 11: secret scans.

Three fixed patterns give the base spans: assignments of passwords and tokens, access key ids, and long
hexadecimal runs, each leftmost and without overlaps among its own kind; matches that are too short are
used up, then dropped. The token-efficiency test adds the rest: runs of key characters that a byte-level BPE
vocabulary needs many tokens for are random strings. Prose gets 2 to 5 characters a token, random strings 1 to
1.8. A run counts as ``random`` if

* it has ``LEAST`` characters or more (and up to two ``=`` at its end),
* its characters are of two kinds at least: lower-case, upper-case (the first letter aside), digits,
* it isn't a known digest (hexadecimal of a digest's length) or an identifier (a UUID, a number, a number with signs in between),
* it has under ``RATIO`` characters a token, and
* no base span holds all of it.

Runs are tested whole; those of over ``BLOCK`` characters are encoded in blocks of that size, whose tokens
add up. All places are code points, ends exclusive. Texts that hold none of the needed characters are
passed over by a linear scan of the whole batch.

Null, empty and blank texts have no spans. Repeated rows give the same spans each. Rows without an id stay, with a
null id. An empty table gives an empty table. Only ``key`` columns pass through, whatever other columns are called; a ``key``
named like the output column isn't allowed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.bpe import ByteBpe, _coder
from seqloom.llm.common import map_text

#: Kinds in the order in which spans that start together are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "random")
LEAST, RATIO, BLOCK = 16, 1.8, 512

#: Fixed patterns of the base spans, and the least size of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
#: Sizes of digests in hexadecimal: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
KNOWN = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_-]+")
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
CLASSES = (re.compile(r"[a-z]"), re.compile(r"(?<!^)[A-Z]"), re.compile(r"[0-9]"))
#: What a text must hold for a pattern to be tried at all.
MAY_ASSIGN = r"(?i)passw|secret|token|api_?key"
MAY_RUN = rf"[A-Za-z0-9+/_-]{{{LEAST}}}"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in no order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def testable(run: str) -> bool:
    """Whether a run is neither of one kind of characters nor a known digest or identifier."""
    if HEX_ONLY.fullmatch(run) and len(run) in DIGESTS or KNOWN.fullmatch(run):
        return False
    return sum(bool(c.search(run)) for c in CLASSES) > 1


def tokens_of(coder: ByteBpe, runs: list[str]) -> np.ndarray:
    """Tokens of each run; long runs block by block."""
    numbers: dict[bytes, int] = {}
    owner, piece = [], []
    for n, run in enumerate(runs):
        for at in range(0, len(run), BLOCK):
            for p in coder.find(run[at : at + BLOCK]):
                owner.append(n)
                piece.append(numbers.setdefault(p.encode(), len(numbers)))
    _, counts = coder.pieces_to_ids(list(numbers))
    return np.bincount(owner, np.asarray(counts)[piece], len(runs))


def scan(texts: pa.Array, coder: ByteBpe) -> list[list[tuple[int, int, int]]]:
    """Sorted (start, kind, end) spans of each text."""
    assigns = pc.match_substring_regex(texts, MAY_ASSIGN).to_pylist()
    runs_in = pc.match_substring_regex(texts, MAY_RUN).to_pylist()
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    runs: dict[str, int] = {}
    found = []
    for n in np.flatnonzero(np.array(assigns, bool) | np.array(runs_in, bool)).tolist():
        text = texts[n].as_py()
        if runs_in[n]:
            out[n] = base_spans(text)
            for m in RUN.finditer(text):
                run = m.group()
                if (run in runs or testable(run)) and not any(a <= m.start() and m.end() <= b for a, _, b in out[n]):
                    found.append((n, m.start(), m.end(), runs.setdefault(run, len(runs))))
        else:
            out[n] = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if found:
        names = list(runs)
        low = np.array([len(r) for r in names]) < RATIO * tokens_of(coder, names)
        for n, a, b, r in found:
            if low[r]:
                out[n].append((a, 3, b))
    for spans in out:
        spans.sort()
    return out


def secret_spans(docs: DataFrame, ranks_path: str, pattern: str, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns and ``spans``: array of (kind, start, stop), by start, then kind as in ``KINDS``."""

    def make():
        coder = _coder(ranks_path, pattern)

        def run(texts: pa.Array) -> list:
            spans = scan(texts, coder)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in spans], dtype=np.int64)))
            flat = [x for s in spans for x in s]
            fields = [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())]
            values = pa.StructArray.from_arrays(fields, ["kind", "start", "stop"])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]

        return run

    return map_text(docs, key, text, "spans array<struct<kind:string,start:bigint,stop:bigint>>", make, kind="arrow")


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
