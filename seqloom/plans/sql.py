"""Building blocks of the DuckDB oracles: the views that the queries start from, written out in SQL."""

from __future__ import annotations

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ.", "ACCTTGGAACCTTGGAACCTTGGAACA"


def norm(text: str) -> str:
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z.]', '', 'g')), '{LETTERS}', '{BASES}')"


def rc(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACTG', 'TGAC'))"


def num(seq: str) -> str:
    return f"translate({seq}, 'ACTG', '0123')"


def reads(k: int, name: str = "reads") -> str:
    return f"{name} AS (SELECT * FROM (SELECT doc_id AS read_id, source AS lib_id, {norm('text')} AS seq FROM documents) WHERE length(seq) >= {k + 1})"


def occurrences(source: str, key: str, k: int, name: str = "occ") -> str:
    """Windows with canonical word, direction and neighbouring bases."""
    comp = "CASE {0} WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'T' THEN 'A' WHEN 'G' THEN 'C' ELSE '' END"
    return f"""
    {name}_w AS (SELECT {key}, unnest(range(0, length(seq) - {k} + 1)) AS j, seq FROM {source} WHERE length(seq) >= {k}),
    {name}_f AS (SELECT {key}, j, substr(seq, j + 1, {k}) AS w, CASE WHEN j > 0 THEN substr(seq, j, 1) ELSE '' END AS p, substr(seq, j + {k} + 1, 1) AS x FROM {name}_w),
    {name}_r AS (SELECT *, {rc('w')} AS rw FROM {name}_f),
    {name}_c AS (SELECT *, {num('w')} < {num('rw')} AS fwd FROM {name}_r),
    {name} AS (SELECT {key}, j, fwd, CASE WHEN fwd THEN w ELSE rw END AS km,
        CASE WHEN fwd THEN p ELSE {comp.format('x')} END AS l, CASE WHEN fwd THEN x ELSE {comp.format('p')} END AS r FROM {name}_c)"""


def kmers(source: str = "occ", name: str = "kmers") -> str:
    links = ", ".join(f"CAST(least(63, count(*) FILTER ({s} = '{b}')) AS INTEGER) AS {s}{i}" for s in "lr" for i, b in enumerate("ACTG"))
    return f"{name} AS (SELECT km, count(*) AS cnt, {links} FROM {source} GROUP BY km)"


def degree(side: str) -> str:
    return "(" + " + ".join(f"CAST({side}{i} > 0 AS INTEGER)" for i in range(4)) + ")"


def total(side: str) -> str:
    return "(" + " + ".join(f"{side}{i}" for i in range(4)) + ")"


def neighbours(k: int, source: str = "kmers", name: str = "nbrs") -> str:
    rows = " UNION ALL ".join(
        f"SELECT km, '{s}' AS side, {i} AS base, {s}{i} AS n, " + (f"substr(km, 2) || '{b}'" if s == "r" else f"'{b}' || left(km, {k - 1})") + f" AS word FROM {source} WHERE {s}{i} > 0"
        for s in "lr" for i, b in enumerate("ACTG")
    )
    return f"""{name}_w AS ({rows}),
    {name} AS (SELECT km, side, base, n, CASE WHEN {num('word')} < {num(rc('word'))} THEN word ELSE {rc('word')} END AS nbr FROM {name}_w)"""


def table(k: int) -> str:
    return f"WITH {reads(k)}, {occurrences('reads', 'read_id', k)}, {kmers()}"
