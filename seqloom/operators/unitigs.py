"""Unitigs of the k-mer graph by pointer doubling, their tips, and the arcs that reads walk.

A node is an oriented k-mer, numbered ``2 * km + (0 if '+' else 1)``. A step leads from a node
over its only live link out. Chains of linear nodes are found by doubling: each round
joins every open node's pointer with its target's, so chains of n nodes take log2(n)
rounds; finished nodes leave the join. Circles without a branching node never end
and are dropped.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.components import cut, recut
from seqloom.operators.kmers import LEFT, RIGHT, marked, neighbours, without
from seqloom.operators.rank import numbered


def node(km: Column, plus: Column) -> Column:
    return F.shiftleft(km, 1).bitwiseOR(F.when(plus, 0).otherwise(1).cast("long"))


def flip(n: Column) -> Column:
    return n.bitwiseXOR(F.lit(1).cast("long"))


def steps(kmers: DataFrame, k: int) -> DataFrame:
    """(u, v, base, n): all steps between live oriented k-mers, in both directions; base is what v appends."""
    links = neighbours(kmers, k)
    live = links.join(kmers.select(F.col("km").alias("nbr")), "nbr", "left_semi")
    # Leaving over a right link goes along '+', over a left link along '-' (and adds the base's complement).
    u = node(F.col("km"), F.col("side") == "r")
    # Entering a k-mer on its left side runs along '+', on its right side along '-'.
    v = node(F.col("nbr"), F.col("nbr_side") == "l")
    base = F.when(F.col("side") == "r", F.col("base")).otherwise(F.col("base").bitwiseXOR(F.lit(2)))
    return live.select(u.alias("u"), v.alias("v"), base.alias("base"), "n")


def pointers(kmers: DataFrame, k: int, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of linear nodes by doubling.

    Gives the steps from nodes that aren't linear, (u, v, base, n, on), those from linear ones (with ``own``, u's
    left links; ``on``: v is linear), and (u, tail, far): each linear node with its chain's last
    linear node and how many steps off that is. Circles have no last node, and chains of over
    ``most`` nodes may be left out.
    """
    info = marked(kmers).select("km", "linear", F.expr("l0 + l1 + l2 + l3").alias("own"))
    both = info.select(F.explode(F.array(node(F.col("km"), F.lit(True)), node(F.col("km"), F.lit(False)))).alias("u"), "linear", "own")
    linear = both.where("linear").select("u", "own")
    edge = steps(kmers, k).join(linear.select(F.col("u").alias("v"), F.lit(True).alias("on")), "v", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    edge = cut(edge.join(linear, "u", "left").select("u", "v", "base", "n", "on", "own"))
    starts, inner = edge.where("own is null").drop("own"), edge.where("own is not null")
    state = inner.select("u", F.when(F.col("on"), F.col("v")).otherwise(F.col("u")).alias("tail"), F.col("on").cast("int").alias("far"), (~F.col("on")).alias("done"))
    state = cut(state)
    for _ in range((most or inner.count()).bit_length()):  # what is open after that is a circle, or too long
        if state.where("not done").isEmpty():
            break
        nxt = state.select(F.col("u").alias("tail"), F.col("tail").alias("tail2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(nxt, "tail").where("tail2 <> u")  # back at the start
        moved = moved.select("u", F.col("tail2").alias("tail"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        state = recut(state.where("done").unionByName(moved), state)
    return starts, inner, state.where("done").drop("done")


def chains(kmers: DataFrame, k: int, found: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(head, first, tail, end, len, cov, letters): all walks from a node that isn't linear over linear ones to the next that isn't.

    ``first`` is the first node after ``head``, ``tail`` the last before ``end`` (null if none is between), ``len`` counts
    the nodes after ``head``, ``cov`` adds up the left links of the linear ones, ``letters`` are the bases that the walk appends.
    """
    starts, inner, members = found or pointers(kmers, k)
    letter = F.element_at(F.array(*map(F.lit, "ACTG")), F.col("base") + 1)
    # A chain's letters are put together once; a unitig is one value in the result, too.
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("at"), letter.alias("letter"), "u", "v")))
    chain = members.join(inner, "u").groupBy("tail").agg(in_order.alias("m"), F.sum("own").alias("cov"))
    chain = chain.select(
        F.col("m")[0]["u"].alias("v"),
        "tail",
        F.element_at("m", -1)["v"].alias("end"),
        F.size("m").alias("inner"),
        "cov",
        F.array_join(F.transform("m", lambda x: x["letter"]), "").alias("rest"),
    )
    joined = starts.join(chain, "v", "left").where("not on or end is not null")  # else it leads into a circle
    return joined.select(
        F.col("u").alias("head"),
        F.col("v").alias("first"),
        "tail",
        F.coalesce("end", "v").alias("end"),
        (F.lit(1) + F.coalesce("inner", F.lit(0))).alias("len"),
        F.coalesce("cov", F.lit(0)).cast("long").alias("cov"),
        F.concat(letter, F.coalesce("rest", F.lit(""))).alias("letters"),
    )


def unitigs(kmers: DataFrame, k: int, cap: int = 16_000) -> DataFrame:
    """(head, end, len, cvg10, letters, is_palindrome): each unitig in one of its two directions.

    Coverage is the whole mean of the inner nodes' left links, times 10; a unitig of length 1 has its first k-mer's count.
    """
    walk = chains(kmers, k).withColumn("rc_head", flip(F.col("end"))).withColumn("rc_end", flip(F.col("head")))
    whole = F.concat(kmer_letters(F.col("head"), k), F.col("letters"))
    walk = walk.withColumn("seq", whole).withColumn("rc", F.reverse(F.translate("seq", "ACTG", "TGAC")))
    keep = walk.where(F.translate("seq", "ACTG", "0123") <= F.translate("rc", "ACTG", "0123"))
    counts = kmers.select("km", "cnt")
    keep = keep.join(counts.withColumnRenamed("km", "hk"), F.shiftright("head", 1) == F.col("hk"))
    cvg = F.when(F.col("len") == 1, F.col("cnt") * 10).otherwise(F.expr("cov div (len - 1)") * 10)
    return keep.select("head", "end", "len", F.least(F.lit(cap), cvg).cast("long").alias("cvg10"), "seq", (F.col("seq") == F.col("rc")).alias("is_palindrome")).distinct()


def kmer_letters(n: Column, k: int) -> Column:
    """The spelling of an oriented k-mer."""
    from seqloom.functions.seq import revcomp, unpack

    plus = unpack(F.shiftright(n, 1), k)
    return F.when(n.bitwiseAND(F.lit(1).cast("long")) == 0, plus).otherwise(revcomp(plus))


def tips(kmers: DataFrame, k: int, single: bool = False) -> DataFrame:
    """(km): k-mers of tips, one synchronous round.

    A tip is a walk of fewer than 2k steps from a dead end. It goes if it ends at a dead end,
    too (an isolated piece); else if its last link is weaker than the strongest on that
    side of the end, or (``single``) if all its k-mers were seen once. Walks are
    followed over 2k nodes only, however long the graph's chains are.
    """
    info = marked(kmers).select("km", (F.col("n_left") + F.col("n_right")).alias("links"), F.greatest(*LEFT).alias("left"), F.greatest(*RIGHT).alias("right"), "single")
    starts, inner, members = pointers(kmers, k, 2 * k)
    dead = info.where("links = 1").select(F.col("km").alias("dead"), F.col("single").alias("head_single"))
    one = starts.join(dead, F.shiftright("u", 1) == F.col("dead")).select(F.col("u").alias("head"), "v", "n", "on", "head_single")
    # Walks of one step end at v; others at what follows their chain's last node.
    chain = members.where(F.col("far") + 2 < 2 * k).select(F.col("u").alias("v"), "tail")
    long = one.where("on").select("head", "v", "head_single").join(chain, "v").join(inner.select(F.col("u").alias("tail"), F.col("v").alias("end"), "n"), "tail")
    walk = long.select("head", "tail", "end", "n", "head_single").unionByName(one.where("not on").select("head", F.lit(None).cast("long").alias("tail"), F.col("v").alias("end"), "n", "head_single"))
    ends = info.select(F.col("km").alias("end_km"), "links", "left", "right")
    walk = walk.join(ends, F.shiftright("end", 1) == F.col("end_km"))
    # Along '+' a walk arrives at the left side.
    top = F.when(F.col("end").bitwiseAND(F.lit(1).cast("long")) == 0, F.col("left")).otherwise(F.col("right"))
    walk = cut(walk.withColumn("alone", F.col("links") == 1).withColumn("weaker", F.col("n") < top).where("head_single or alone" if single else "alone or weaker"))
    inside = members.select("tail", F.shiftright("u", 1).alias("km")).join(walk.where("tail is not null").select("tail", "head", "alone"), "tail").select("head", "alone", "km")
    if single:
        seen = inside.join(info.select("km", "single"), "km").groupBy("head").agg(F.bool_and("single").alias("all_single"))
        often = seen.where("not all_single").select("head")
        walk = cut(walk.join(often, "head", "left_anti").unionByName(walk.join(often, "head", "left_semi").where("alone")))
        inside = inside.join(walk.select("head"), "head", "left_semi")
    found = inside.select("km").unionByName(walk.select(F.shiftright("head", 1).alias("km"))).unionByName(walk.where("alone").select(F.shiftright("end", 1).alias("km")))
    return found.distinct()


def without_tips(kmers: DataFrame, k: int, rounds: int | None = None, single: bool = False) -> DataFrame:
    """Rounds of tip removal until none is left (each takes a k-mer away), or just the first ``rounds``."""
    kmers = cut(kmers)
    for _ in count() if rounds is None else range(rounds):
        found = cut(tips(kmers, k, single))
        if found.isEmpty():
            break
        kmers = cut(without(kmers, found, k))
    return kmers


def edge_table(kmers: DataFrame, k: int, cap: int = 16_000) -> tuple[DataFrame, DataFrame]:
    """Unitigs as edges, and the linear nodes on them.

    Edges (edge_id, src, first, last, dst, len, cvg10, seq, is_palindrome) are numbered by length and spelling, one row for both directions;
    nodes (n, oe) name the oriented edge of each linear node: 2 * edge_id, plus 1 against the row's direction.
    """
    found = pointers(kmers, k)
    walk = cut(chains(kmers, k, found).withColumn("seq", F.concat(kmer_letters(F.col("head"), k), F.col("letters"))))
    walk = walk.withColumn("rc", F.reverse(F.translate("seq", "ACTG", "TGAC")))
    own = F.translate("seq", "ACTG", "0123") <= F.translate("rc", "ACTG", "0123")
    counts = kmers.select(F.col("km").alias("hk"), "cnt")
    keep = walk.where(own).join(counts, F.shiftright("head", 1) == F.col("hk"))
    cvg = F.when(F.col("len") == 1, F.col("cnt") * 10).otherwise(F.expr("cov div (len - 1)") * 10)
    keep = keep.select(
        F.col("head").alias("src"), "first", F.coalesce("tail", "head").alias("last"), F.col("end").alias("dst"), "len",
        F.least(F.lit(cap), cvg).cast("long").alias("cvg10"), "seq", (F.col("seq") == F.col("rc")).alias("is_palindrome"),
    )
    edges = cut(numbered(keep.distinct(), ["len", "seq"], "edge_id"))
    names = oriented(edges).select(F.col("src").alias("head"), "first", "oe")
    tails = walk.where("tail is not null").select("head", "first", "tail").join(names, ["head", "first"]).select("tail", "oe")
    return edges, cut(found[2].join(tails, "tail").select(F.col("u").alias("n"), "oe"))


def oriented(edges: DataFrame) -> DataFrame:
    """(oe, src, first, dst, len, cvg10): both directions of each edge; a palindrome has one."""
    plus = edges.select((F.col("edge_id") * 2).alias("oe"), "src", "first", "dst", "len", "cvg10")
    minus = edges.where("not is_palindrome").select(
        (F.col("edge_id") * 2 + 1).alias("oe"), flip(F.col("dst")).alias("src"), flip(F.col("last")).alias("first"), flip(F.col("src")).alias("dst"), "len", "cvg10"
    )
    return plus.unionByName(minus)


def vertices(kmers: DataFrame) -> DataFrame:
    """(km): the k-mers that edges begin and end at."""
    return marked(kmers).where("not linear").select("km")


def read_paths(occ: DataFrame, kmers: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(read_id, j, oe): the edges that each read runs along, each once for a stretch of it.

    A linear k-mer names its edge; two neighbouring k-mers that aren't linear name the edge of length 1
    between them. A k-mer that is gone, or on no edge, ends a stretch of path; of a read's stretches the first
    with two edges or more is kept.
    """
    ends = vertices(kmers).select(F.explode(F.array(node(F.col("km"), F.lit(True)), node(F.col("km"), F.lit(False)))).alias("n"), F.lit(None).cast("long").alias("oe"))
    known = nodes.unionByName(ends).withColumn("known", F.lit(True))
    at = occ.select("read_id", "j", node(F.col("km"), F.col("fwd")).alias("n")).join(known, "n", "left")
    along = Window.partitionBy("read_id").orderBy("j")
    at = at.withColumn("part", F.sum(F.col("known").isNull().cast("int")).over(along))
    at = at.withColumn("next", F.when(F.lead("known").over(along) & F.lead("oe").over(along).isNull(), F.lead("n").over(along))).where("known")
    short = oriented(edges).where("len = 1").select(F.col("src").alias("n"), F.col("first").alias("next"), F.col("oe").alias("short"))
    on = at.where("oe is not null").select("read_id", "part", "j", "oe")
    between = at.where("oe is null and next is not null").join(short, ["n", "next"]).select("read_id", "part", "j", F.col("short").alias("oe"))
    part = Window.partitionBy("read_id", "part").orderBy("j")
    path = on.unionByName(between).withColumn("before", F.lag("oe").over(part)).where("before is null or before <> oe")
    whole = path.withColumn("edges", F.count(F.lit(1)).over(Window.partitionBy("read_id", "part"))).where("edges > 1")
    return whole.withColumn("one", F.min("part").over(Window.partitionBy("read_id"))).where("part = one").select("read_id", "j", "oe")


def twin_edge(oe: Column, palindrome: Column) -> Column:
    """The other direction of an oriented edge; a palindrome is its own."""
    return F.when(palindrome, oe).otherwise(oe.bitwiseXOR(F.lit(1).cast("long")))


def edge_arcs(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(e1, e2, multiplicity): how often reads go from one oriented edge to the next, and their mirrors from twin to twin; only edges that meet."""
    along = Window.partitionBy("read_id").orderBy("j")
    two = paths.withColumn("e2", F.lead("oe").over(along)).where("e2 is not null").groupBy(F.col("oe").alias("e1"), "e2").agg(F.count(F.lit(1)).alias("m"))
    own = edges.where("is_palindrome").select((F.col("edge_id") * 2).alias("p"))
    two = two.join(own.select(F.col("p").alias("e1"), F.lit(True).alias("p1")), "e1", "left").join(own.select(F.col("p").alias("e2"), F.lit(True).alias("p2")), "e2", "left")
    side = lambda c, p: twin_edge(F.col(c), F.coalesce(p, F.lit(False)))
    mirror = two.select(side("e2", "p2").alias("e1"), side("e1", "p1").alias("e2"), "m")
    all_ = two.select("e1", "e2", "m").unionByName(mirror).groupBy("e1", "e2").agg(F.sum("m").alias("multiplicity"))
    o = oriented(edges)
    return all_.join(o.select(F.col("oe").alias("e1"), F.col("dst").alias("at")), "e1").join(o.select(F.col("oe").alias("e2"), F.col("src").alias("at")), ["e2", "at"]).select("e1", "e2", "multiplicity")


def read_walks(occ: DataFrame, kmers: DataFrame) -> DataFrame:
    """(read_id, i, a, b): steps between branching k-mers that follow each other in a read (MAP-1 in k-mer form).

    A read walks from branching k-mer to branching k-mer along one unitig each; a k-mer that
    was removed ends the walk. Consecutive pairs are the arcs' evidence.
    """
    info = marked(kmers).select("km", "linear")
    at = occ.join(info, "km", "left").select("read_id", "j", node(F.col("km"), F.col("fwd")).alias("n"), "linear")
    along = Window.partitionBy("read_id").orderBy("j")
    at = at.withColumn("part", F.sum(F.col("linear").isNull().cast("int")).over(along)).where("linear is not null and not linear")
    part = Window.partitionBy("read_id", "part").orderBy("j")
    return at.select("read_id", "j", F.col("n").alias("a"), F.lead("n").over(part).alias("b")).where("b is not null")


def arcs(occ: DataFrame, kmers: DataFrame) -> DataFrame:
    """(a, b, c, multiplicity): how often reads walk unitig a-b and then b-c; a walk and its mirror are one."""
    walks = read_walks(occ, kmers)
    along = Window.partitionBy("read_id").orderBy("j")
    two = walks.withColumn("b2", F.lead("a").over(along)).withColumn("c", F.lead("b").over(along)).where("b = b2")
    own = F.struct("a", "b", "c")
    mirror = F.struct(flip(F.col("c")).alias("a"), flip(F.col("b")).alias("b"), flip(F.col("a")).alias("c"))
    return two.select(F.least(own, mirror).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("multiplicity")).select("p.*", "multiplicity")
