"""Near-duplicate removal with SimHash ball hashing (operator 8) and verified pairs.

Similarity is Jaccard's of five-word shingles, ``LEAST`` or more. One edit changes five
shingles, so shingle fingerprints of such pairs differ in some 8 bits, out of a ball's
reach. Fingerprints of single words differ far less: each text gets ``len(VIEWS)`` of them
with hashes of their own, words weighted by the square root of their count, and meets others
within three bits in any view by ball hashing. Pairs that met are verified: first by
the distance of their shingle fingerprints, then by the similarity of their shingles
(distinct ones, hashed to 32 bits). That connects most of large groups cheaply, but not all
near pairs meet so, nor are all that meet kept.

The rest is exact. Each text's n shingles are put in one order. Of two
texts of ``LEAST`` similarity or more, each has a shingle of the other's among its first
n - ceil(0.8 n) + 1, and at the first such shingle enough are left in both for what they must share. Texts
that meet on one, are not connected yet and have enough left are verified; no pair is missed.
The order only decides how many meet: shingles come by the number of texts that hold them, counted over all
texts, and those that only texts of one component hold come first and meet nobody. Hot ones, in ``HOT`` or more of some ``SAMPLE`` texts, come last;
they are looked up where texts are read, so that none of them is counted in one task.
A group of very many near copies would meet in all pairs: in ``TURNS`` turns the texts of each first shingle are dealt into
heaps and meet one text of theirs first, so that most of the group is one component. What is left meets all.
Components of verified pairs are the groups; of each the document of least id stays.

Equal texts are one node. Null texts count as empty; texts without words are near only
to equal ones. Repeated rows of one id and text count once, other texts of one id apart; a missing id
is greater than any. All columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.chunks import ChunkMemo
from seqloom.llm.common import discard, free, kept, map_text, scratch, stored, sweep
from seqloom.llm.simhash import PART, near_links
from seqloom.operators.components import connected_components

WIDTH = 5
LEAST = 0.8
#: The power of a word's count that weighs it in each view.
VIEWS = (0.5,) * 5
#: Bits in which the shingle fingerprints of a pair of ``LEAST`` similarity or more may differ: 10 and 5 deviations of 3.
FAR = 25
#: Texts that are looked at for hot shingles, in how many a hot one is, and how many are sent to the tasks.
SAMPLE, HOT, COMMON = 10_000, 50, 300_000
#: Rows of some 100 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Heaps and turns of stars.
STARS, TURNS = 16, 2

#: Stands for a document's missing id.
NO_ID = (1 << 63) - 1

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class WordViews:
    """Fingerprints of a text's words."""

    def __init__(self):
        self.reset()
        self.memo = ChunkMemo(self.resolve, self.reset)

    def reset(self) -> None:
        self.hashes = np.empty((0, len(VIEWS)), np.uint64)

    def resolve(self, words: list[bytes]) -> None:
        h = xxhash.xxh64_intdigest
        new = np.array([[h(w, seed) for seed in range(len(VIEWS))] for w in words], np.uint64)
        self.hashes = np.concatenate((self.hashes, new))

    def of(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(VIEWS)), np.uint64)
        numbers, counts = self.memo.numbers([t.translate(_FOLD).split() for t in texts])
        ends = np.cumsum(counts)
        for n, (a, z) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
            if a == z:
                continue
            word, times = np.unique(numbers[a:z], return_counts=True)
            for v, power in enumerate(VIEWS):
                weight = (times**power).astype(np.float32)
                bits = np.unpackbits(self.hashes[word, v].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                out[n, v] = np.packbits(2 * (weight @ bits) > weight.sum(), bitorder="little").view(np.uint64)[0]
        return out


def shingle_hashes(text: bytes) -> np.ndarray:
    """All shingles of a text, hashed; fewer words than a shingle: the whole sequence."""
    words = text.translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    last = max(1, len(words) - WIDTH + 1)
    return np.fromiter((h(b" ".join(words[i : i + WIDTH])) for i in range(last)), np.uint64, last)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):
        ones += np.unpackbits(hashes[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def distinct(hashes: np.ndarray, hot: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct shingles of 32 bits: those that aren't ``hot`` (sorted), then these by how often they occur; how many are not."""
    found = np.unique(hashes.astype(np.uint32))
    if not len(hot):
        return found, len(found)
    at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
    often = np.where(hot[at] == found, times[at], 0)
    return found[np.argsort(often, kind="stable")], int((often == 0).sum())


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.uint32)]).view(np.int32)))


def frequent(named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in ``HOT`` or more texts of a sample, sorted, and in how many: at most ``COMMON``."""

    def make():
        return lambda texts: [_lists([np.unique(shingle_hashes(t).astype(np.uint32)) for t in texts])]

    every = max(1, named.count() // SAMPLE)
    some = named.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    codes = map_text(some, [], "text", "codes array<int>", make, "bytes").select(F.explode("codes").alias("code"))
    counted = codes.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "code").limit(COMMON).toArrow()
    code, n = counted["code"].to_numpy().view(np.uint32), counted["n"].to_numpy()
    order = np.argsort(code)
    return code[order], n[order]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those of ``LEAST`` similarity or more."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    shared = F.size(F.array_intersect("sa", "sb"))
    near = shared >= LEAST * (F.size("sa") + F.size("sb") - shared) - 1e-9
    return small(pairs).join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")


def prefixes(sets: DataFrame) -> DataFrame:
    """(node, part, n, pos, code): of the first shingles of each set (node, component, n, rare, shingles), those that other parts have too.

    ``part`` is the component, or the node itself where that is null.
    """
    first = F.col("n") - F.ceil(LEAST * F.col("n") - 1e-9).cast("int") + 1
    part = F.coalesce("component", "node")
    # The one shuffle of all shingles: its rows hold no more than it takes to see which are shared.
    rare = sets.select("node", "component", F.explode(F.slice("shingles", 1, F.col("rare"))).alias("code"))
    code = Window.partitionBy("code")
    # The bounds of the parts tell if there are two; a count of distinct ones isn't needed.
    shared = rare.withColumns({"texts": F.count("*").over(code), "low": F.min(part).over(code), "high": F.max(part).over(code)}).where("low <> high")
    # A text whose shingles are its own for more than the first ones meets nobody.
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("texts", "code"))).alias("found"))
    lists = lists.join(sets.select("node", part.alias("part"), "n", "rare"), "node")
    own = F.col("rare") - F.size("found")
    lists = lists.withColumn("own", own).where(F.col("own") < first)
    counted = lists.select("node", "part", "n", "own", F.posexplode(F.slice("found.code", 1, first - F.col("own"))).alias("at", "code"))
    counted = counted.select("node", "part", "n", (F.col("own") + F.col("at")).alias("pos"), "code")
    hot = sets.where(F.col("rare") < first).select("node", part.alias("part"), "n", "rare", F.posexplode(F.slice("shingles", F.col("rare") + 1, first - F.col("rare"))).alias("at", "code"))
    return counted.unionByName(hot.select("node", "part", "n", (F.col("rare") + F.col("at")).alias("pos"), "code"))


def prefix_pairs(put: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that may be near: all that are, and others."""
    x, y = put.alias("x"), put.alias("y")
    need = F.ceil(LEAST / (1 + LEAST) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    met = (F.col("x.code") == F.col("y.code")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & (left >= need)
    return x.join(y, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def star_pairs(put: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of nodes of different parts: the nodes of a shingle are dealt into ``STARS`` heaps, and all of a heap meet one of it."""
    deal = lambda salt: F.xxhash64("node", "code", F.lit(turn), F.lit(salt))
    dealt = put.withColumns({"heap": F.pmod(deal(0), F.lit(STARS)), "x": F.struct("node", "part", "n")})
    centres = dealt.groupBy("code", "heap").agg(F.min(F.struct(deal(1).alias("order"), "node", "part", "n")).alias("y"))
    size = F.least("x.n", "y.n") >= LEAST * F.greatest("x.n", "y.n") - 1e-9
    met = dealt.select("code", "heap", "x").join(centres, ["code", "heap"]).where((F.col("x.part") != F.col("y.part")) & size)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _parted(df: DataFrame, parts: DataFrame) -> DataFrame:
    """``df`` with the part of each node: its component so far, or the node itself."""
    return df.drop("part").join(small(parts), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def _extended(parts: DataFrame, true: DataFrame) -> DataFrame:
    """The components ``parts`` with more links."""
    return stored(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(true)), "near-parts")


def _searched(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """``parts`` joined by all near pairs: first by those of some turns of stars, so that a large group is one part before all that may be near meet."""
    spark = sets.sparkSession
    put = stored(prefixes(sets.where("n > 0")), "near-first")
    for turn in range(TURNS):
        some = stored(star_pairs(_parted(put, parts), turn), "near-stars")
        sweep(spark)
        parts = _extended(parts, _verified(some, sets))
        sweep(spark)
    rest = stored(prefix_pairs(_parted(put, parts)), "near-rest")
    sweep(spark)
    return _extended(parts, _verified(rest, sets))


def _viewed(named: DataFrame, path: str) -> DataFrame:
    """(id, digest, fps, whole, rare, shingles) of every row, written to ``path``."""

    def views():
        words, (hot, times) = kept("near views", WordViews), shared.value

        def run(texts: list[bytes]) -> list:
            fps = words.of(texts)
            ends = pa.array(np.arange(0, fps.size + 1, len(VIEWS)), pa.int32())
            hashed = [shingle_hashes(t) for t in texts]
            whole = np.fromiter(map(fingerprint, hashed), np.uint64, len(texts)).view(np.int64)
            found = [distinct(h, hot, times) for h in hashed]
            rare = pa.array([r for _, r in found], pa.int32())
            return [pa.ListArray.from_arrays(ends, pa.array(fps.ravel().view(np.int64))), pa.array(whole), rare, _lists([f for f, _ in found])]

        return run

    shared = named.sparkSession.sparkContext.broadcast(frequent(named))
    marked = map_text(named, ["id", "digest"], "text", "fps array<long>, whole long, rare int, shingles array<int>", views, "bytes")
    marked.write.parquet(path)
    return named.sparkSession.read.schema(marked.schema).parquet(path)


def _met(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose word fingerprints are near in some view and whose shingle fingerprints may be."""
    seen = nodes.where("n > 0").select("node", "whole", F.posexplode("fps").alias("view", "fp")).withColumn("view", F.col("view").cast("byte"))
    # Shingle fingerprints travel with their nodes, so that pairs need no joins to find them.
    centres = stored(seen.groupBy("view", "fp").agg(F.min("node").alias("centre"), F.min_by("whole", "node").alias("own")), "near-centres")
    dealt = small(centres)
    same = seen.join(dealt, ["view", "fp"]).select(F.col("node").alias("x"), F.col("whole").alias("wx"), F.col("centre").alias("y"), F.col("own").alias("wy"))
    links = near_links(centres.select("view", "fp"))
    at = lambda name, to: dealt.select("view", F.col("fp").alias(name), F.col("centre").alias(to), F.col("own").alias(f"w{to}"))
    across = links.join(at("a", "x"), ["view", "a"]).join(at("b", "y"), ["view", "b"]).select("x", "wx", "y", "wy")
    may = (F.col("x") != F.col("y")) & (F.bit_count(F.col("wx").bitwiseXOR(F.col("wy"))) <= FAR)
    pairs = same.unionByName(across).where(may).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return stored(pairs, "near-pairs")


def _with_components(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """``sets`` with their component so far, null where they have none."""
    return stored(sets.join(small(parts), "node", "left"), "near-parted")


def _distinct_texts(marked: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's (id, digest); a node for each text; its shingles, from its row of least id, written to ``path``."""
    rows = stored(marked.select("id", "digest").distinct(), "near-rows")
    nodes = marked.withColumn("n", F.size("shingles")).groupBy("digest").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("fps", "whole", "n")))
    nodes = stored(nodes.withColumn("node", F.xxhash64("digest")), "near-nodes")
    own = small(nodes.select("node", F.col("least").alias("id"), "digest"))
    sets = marked.join(own, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("node", "rare", F.size("shingles").alias("n"), "shingles")
    sets.write.parquet(path)
    return rows, nodes, marked.sparkSession.read.schema(sets.schema).parquet(path)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, component, kept): the near-duplicate group, by its least id, of each distinct id and text; which one of it stays.

    Shuffle files and tables of a step that is written out are removed before the next one.
    """
    spark = docs.sparkSession
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.unhex(F.md5(plain.cast("binary"))).alias("digest"), plain.alias("text"))
    views = scratch(spark, "near-views")
    plain_sets = scratch(spark, "near-sets")
    rows, nodes, sets = _distinct_texts(_viewed(named, views), plain_sets)
    discard(spark, views)
    sweep(spark)
    pairs = _met(nodes)
    sweep(spark)
    parts = stored(connected_components(_verified(pairs, sets)), "near-parts")
    sweep(spark)
    sets = _with_components(sets, parts)
    discard(spark, plain_sets)
    sweep(spark)
    parts = _searched(parts, sets)
    of_text = nodes.join(small(parts), "node", "left").select("digest", "least", F.coalesce("component", "node").alias("part"))
    first = of_text.groupBy("part").agg(F.min(F.struct("least", "digest")).alias("first"))
    of_text = of_text.join(first, "part").select("digest", "first")
    found = small(rows).join(of_text, "digest")
    return found.select(
        F.nullif("id", F.lit(NO_ID)).alias("id"), "digest", F.nullif("first.least", F.lit(NO_ID)).alias("component"), (F.struct(F.col("id").alias("least"), "digest") == F.col("first")).alias("kept")
    )


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are few, else joined by a shuffle: Spark would broadcast any table whose compressed files are small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: that of least id."""
    found = stored(groups(docs, key, text), "near-groups")
    own, mark = free(docs, "own"), free(docs, "mark")
    lost = found.where("not kept").select(F.coalesce("id", F.lit(NO_ID)).alias(own), F.col("digest").alias(mark))
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = docs.withColumn(own, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))).withColumn(mark, F.unhex(F.md5(plain.cast("binary"))))
    kept = marked.join(small(lost), [own, mark], "left_anti")
    if found.count() < docs.count():  # rows that repeat an id and its text
        kept = kept.dropDuplicates([own, mark])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
