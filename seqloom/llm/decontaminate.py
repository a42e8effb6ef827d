"""Operator 2: benchmark decontamination, with DataFrame functions only.

Words are runs of non-blank signs, lower-cased. A shingle is ``WIDTH`` words, or the whole
item if that has fewer. A document leaks an item if a window of as many words as
the item has (the whole document if it has fewer) reaches ``LEAST`` in weighted Jaccard
similarity of shingles, repeats counted.

1. Windows. With S shingles in the item and D in the window (S, or fewer if the document is
   shorter than the item), a similarity of 0.8 needs 4/9 of S + D in common, so windows are
   only laid where a document has that many of the item's shingles within S places. The best window can be shifted right to the next such shingle
   (or the document's end) without losing any, so windows start there; none is missed.
2. Fingerprints. Equal windows of all documents are one row. Its SimHash and the items' are
   64 bits, in ``BLOCKS`` blocks. Fingerprints within ``RADIUS`` bits differ in at most
   ``RADIUS // BLOCKS`` bits in some block, so items list each block's value with all of so
   few bits flipped, and windows of the item's size meet them on a block: all
   within the radius do. Similarity 0.8 differs in some 10 bits, 3 in deviation.
3. The exact similarity of each pair that meets is worked out from the shingles.

Null and blank documents and items have no words: they leak and match nothing. Documents
of one id are told apart by their texts; ``leaks`` has one row for each id (null is one, too) and
item, ``decontaminated`` drops just the rows whose own text leaks. Repeated rows change nothing; an
empty table of documents gives no rows, an empty benchmark drops none. Other columns pass
through ``decontaminated``, whatever their names. The benchmark is broadcast only if its shingles
are few; else it is joined by a shuffle.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import WORD_BREAK, free, stored, sweep

WIDTH = 5
LEAST = 0.8
BLOCKS = 8
BITS = 64 // BLOCKS
RADIUS = 23
#: Rows of at most 100 bytes that may be broadcast.
BROADCAST_ROWS = 500_000
_BLANKS = " \t\n\x0b\x0c\r"


def _words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words``; rows without any go."""
    plain = F.btrim(F.lower(F.col(text).cast("string")), F.lit(_BLANKS))
    return df.withColumn("plain", plain).where("plain <> ''").withColumn("words", F.split("plain", WORD_BREAK)).drop("plain")


def _step(df: DataFrame, name: str) -> DataFrame:
    """``df``, written out; what its plan and broadcasts took of the driver's memory is free for the next step."""
    out = stored(df, name)
    sweep(df.sparkSession)
    return out


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its rows are few, else joined by a shuffle, however small its compressed files are."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _shingles(words: Column, width: Column) -> Column:
    """All shingles of a list of words; the whole list if it is shorter."""
    last = F.greatest(F.size(words) - width, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, width), " "))


def _fingerprint(shingles: Column) -> Column:
    """Bits that are set in over half of the shingles' hashes."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def bit(b: Column) -> Column:
        return 2 * F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int")) > F.size(hashes)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda fp, b: F.when(bit(b), fp.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(fp),
    )


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingles."""
    shared = F.aggregate(
        F.array_intersect(a, b),
        F.lit(0),
        lambda n, s: n + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))),
    )
    return shared / (F.size(a) + F.size(b) - shared)


def _blocks(fp: Column, variants: bool) -> Column:
    """(block, value) entries; with all variants of few bits if asked for."""
    masks = [0]
    if variants:
        for n in range(1, RADIUS // BLOCKS + 1):
            masks += [sum(1 << b for b in c) for c in combinations(range(BITS), n)]

    def entries(b: Column) -> Column:
        value = F.call_function("shiftrightunsigned", fp, b * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        return F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(b.alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), entries)))


def _digest(text: str) -> Column:
    """Names a text: rows of equal texts leak the same."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _dense(items: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(id, rid, item, n, width, start): windows of texts (id, rid, words) that hold enough of an item's shingles."""
    sides = items.select("item", "n", "width", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("i"), "words")
    count = items.agg(F.sum("n")).first()[0]
    # The common part of an item's shingles and a window's at the least similarity.
    whole = F.col("n") - F.col("width") + 1
    own = F.greatest(F.size("words") - F.col("width"), F.lit(0)) + 1
    need = F.ceil(F.lit(least / (1 + least)) * (whole + F.least(whole, own)) - F.lit(1e-9)).cast("int")
    last = F.greatest(F.size("words") - F.col("n"), F.lit(0))
    found = None
    for w in [r.width for r in items.select("width").distinct().orderBy("width").collect()]:  # WIDTH at most
        code = lambda at: F.xxhash64(*(F.get("words", F.col(at) + k) for k in range(w)))  # noqa: E731, B023
        wanted = sides.where(F.col("width") == w).select("item", "n", "width", code("i").alias("code")).distinct()
        places = texts.where(F.size("words") >= w).select("id", "rid", "words", F.explode(F.sequence(F.lit(0), F.size("words") - w)).alias("pos"))
        hits = places.withColumn("code", code("pos")).join(_small(wanted, count), "code")
        hits = hits.select("id", "rid", "item", "n", "width", need.alias("need"), last.alias("last"), "pos")
        found = hits if found is None else found.unionByName(hits)
    # Places are whole numbers, at most one a word of the text; the words stay behind.
    grouped = found.groupBy("id", "rid", "item", "n", "width", "need", "last").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    close = F.filter("at", lambda p, i: F.coalesce(F.get(F.col("at"), i + F.col("need") - 1) - p <= F.col("n") - F.col("width"), F.lit(False)))
    starts = F.array_distinct(F.transform(close, lambda p: F.least(p, F.col("last"))))
    return grouped.where(F.size("at") >= F.col("need")).select("id", "rid", "item", "n", "width", F.explode(starts).alias("start"))


def _leaking(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, least: float) -> DataFrame:
    """(id, rid, item, b): each text's leaked items, with the best window's similarity (less than 0) and start."""
    items = _words(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("t")), "t")
    items = _step(items.select("item", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(WIDTH)).alias("width")), "items")
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), _digest(text).alias("rid"))
    if items.isEmpty():
        return named.limit(0).select("id", "rid", F.lit(None).cast(benchmark.schema[item].dataType).alias("item"), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("start")).alias("b"))
    count = items.agg(F.sum("n")).first()[0]
    laid = _step(_dense(items, _words(named, "t").select("id", "rid", "words"), least), "dense")
    # The words of windows, from the texts again: of those that have any.
    wanted = laid.select("rid", "n", "width", "start").distinct()
    own = _words(named.select("rid", "t").join(_small(wanted, wanted.count()), "rid"), "t")
    own = own.select("rid", "n", "width", "start", F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ").alias("window")).distinct()
    own = _step(own, "windows")
    # Equal windows are fingerprinted once.
    windows = own.select("n", "width", "window").distinct().withColumn("shingles", _shingles(F.split("window", " "), F.col("width")))
    windows = _step(windows.withColumn("fp", _fingerprint(F.col("shingles"))), "window-fps")
    targets = items.withColumn("shingles", _shingles(F.col("words"), F.col("width")))
    targets = _step(targets.select("item", "n", "shingles", _fingerprint(F.col("shingles")).alias("fp")), "item-fps")
    items_at = targets.select("item", "n", F.col("fp").alias("item_fp"), _blocks(F.col("fp"), True).alias("at"))
    rows = targets.count() * BLOCKS * sum(math.comb(BITS, k) for k in range(RADIUS // BLOCKS + 1))
    windows_at = windows.select("n", "window", "fp", _blocks(F.col("fp"), False).alias("at"))
    met = windows_at.join(_small(items_at, rows), ["n", "at"])
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("n", "window", "item").distinct()
    pairs = met.join(windows.select("n", "window", "shingles"), ["n", "window"]).join(
        _small(targets.select("item", F.col("shingles").alias("wanted")), count), "item"
    )
    true = pairs.withColumn("similarity", _similarity(F.col("shingles"), F.col("wanted"))).where(F.col("similarity") >= least)
    true = _step(true.select("n", "window", "item", "similarity"), "leak-pairs")
    placed = own.join(true, ["n", "window"]).select("rid", "n", "start", "item", "similarity")
    best = laid.select("id", "rid", "n", "start").distinct().join(placed, ["rid", "n", "start"]).groupBy("id", "rid", "item")
    return best.agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"))).alias("b"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, item, similarity, start): each document's leaked items, the best window's similarity and first word."""
    best = _leaking(docs, benchmark, key, text, item, item_text, least).groupBy("id", "item").agg(F.min("b").alias("b"))
    return best.select(F.col("id").alias(key), F.col("item").alias(item), (-F.col("b.s")).alias("similarity"), F.col("b.start").alias("start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text leaks no item."""
    rid = free(docs, "rid")
    lost = _step(_leaking(docs, benchmark, key, text, item, item_text, LEAST).select(F.col("rid").alias(rid)).distinct(), "leaking")
    return docs.withColumn(rid, _digest(text)).join(_small(lost, lost.count()), rid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
