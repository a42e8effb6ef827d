"""Links between oriented contigs, from single reads and from pairs, and their cleaners.

A link (c1, s1) -> (c2, s2) and its mirror (c2, -s2) -> (c1, -s1) say the same. One of the
two is stored (that of the lesser first end); ``both`` gives both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.seq import twin

END = ["c1", "s1", "c2", "s2"]


def _mirror() -> list[Column]:
    return [F.col("c2").alias("c1"), twin(F.col("s2")).alias("s1"), F.col("c1").alias("c2"), twin(F.col("s1")).alias("s2")]


def both(links: DataFrame) -> DataFrame:
    rest = [c for c in links.columns if c not in END]
    return links.select(*END, *rest).unionByName(links.select(*_mirror(), *rest)).distinct()


def stored_once(df: DataFrame) -> DataFrame:
    """Each link in the direction whose first end is the lesser."""
    rest = [c for c in df.columns if c not in END]
    own, other = F.struct("c1", "s1", "c2", "s2"), F.struct(F.col("c2"), twin(F.col("s2")), F.col("c1"), twin(F.col("s1")))
    keep = own <= other
    return df.select(
        F.when(keep, F.col("c1")).otherwise(F.col("c2")).alias("c1"),
        F.when(keep, F.col("s1")).otherwise(twin(F.col("s2"))).alias("s1"),
        F.when(keep, F.col("c2")).otherwise(F.col("c1")).alias("c2"),
        F.when(keep, F.col("s2")).otherwise(twin(F.col("s1"))).alias("s2"),
        *rest,
    )


def merged(rows: DataFrame) -> DataFrame:
    """(c1, s1, c2, s2, gap, weight): evidence added up; the gap is the whole mean, the weight at most 255."""
    return stored_once(rows).groupBy(*END).agg(
        F.expr("cast(sum(gap) div count(*) as bigint)").alias("gap"), F.least(F.lit(255), F.count(F.lit(1))).cast("int").alias("weight")
    )


def read_links(placed: DataFrame, contigs: DataFrame, k: int, unique: int = 100) -> DataFrame:
    """Links by reads that run from one unique contig on into the next; gap 0 is an overlap of k bases."""
    big = contigs.where(F.col("len") + k >= unique).select("contig_id", "len")
    at = placed.join(big, "contig_id").withColumn("pos", F.col("read_off") + 1 - F.col("ctg_off"))
    along = Window.partitionBy("read_id").orderBy("read_off", "contig_id")
    before = {f"prev_{c}": F.lag(c).over(along) for c in ("contig_id", "strand", "pos", "len")}
    steps = at.withColumns(before).where("prev_contig_id is not null and prev_contig_id <> contig_id")
    steps = steps.withColumn("gap", (F.col("pos") - F.col("prev_pos") - F.col("prev_len")).cast("long")).where("gap >= 0")
    return merged(steps.select(F.col("prev_contig_id").alias("c1"), F.col("prev_strand").alias("s1"), F.col("contig_id").alias("c2"), F.col("strand").alias("s2"), "gap"))


def pair_rows(pairs: DataFrame, k: int) -> DataFrame:
    """Status and gap of each placed pair: (pair_id, insert_size, c1, s1, p1, len1, f, fs, p2, len2) gains status, gap, sample.

    Same orientation is refused; both on one contig sample the insert size; else the gap
    must lie between a tenth of the insert below zero and the insert.
    """
    same = F.col("c1") == F.col("f")
    gap = F.col("insert_size") - k + F.col("p1") + F.col("p2") - F.col("len1") - F.col("len2")
    status = (
        F.when(same & (F.col("s1") == F.col("fs")), "wrong_orientation")
        .when(same, "same_contig")
        .when(gap < -F.expr("insert_size div 10"), "gap_too_small")
        .when(gap > F.col("insert_size"), "gap_too_large")
        .otherwise("linked")
    )
    return pairs.withColumn("status", status).withColumn("gap", gap.cast("long")).withColumn("sample", (F.col("len1") + k - F.col("p1") - F.col("p2")).cast("long"))


def pair_links(rows: DataFrame) -> DataFrame:
    linked = rows.where("status = 'linked'")
    return merged(linked.select("c1", "s1", F.col("f").alias("c2"), twin(F.col("fs")).alias("s2"), "gap"))


def pair_links_by_grade(rows: DataFrame, grade: str = "grade") -> DataFrame:
    """(grade, c1, s1, c2, s2, gap, weight): links by pairs of each insert grade apart."""
    linked = rows.where("status = 'linked'")
    ends = stored_once(linked.select("c1", "s1", F.col("f").alias("c2"), twin(F.col("fs")).alias("s2"), "gap", F.col(grade).alias("grade")))
    return ends.groupBy("grade", *END).agg(F.expr("cast(sum(gap) div count(*) as bigint)").alias("gap"), F.least(F.lit(255), F.count(F.lit(1))).cast("int").alias("weight"))


def merged_grades(links: DataFrame, palindromes: DataFrame) -> DataFrame:
    """(c1, s1, c2, s2, gap, weight, grades): the links of all grades, gaps by weight; contigs (contig_id) that are palindromes are left out."""
    for c in ("c1", "c2"):
        links = links.join(palindromes.select(F.col("contig_id").alias(c)), c, "left_anti")
    gap = F.expr("cast(sum(gap * weight) div sum(weight) as bigint)")
    return links.groupBy(*END).agg(gap.alias("gap"), F.least(F.lit(255), F.sum("weight")).cast("int").alias("weight"), F.count(F.lit(1)).alias("grades"))


def strong(links: DataFrame, least: int = 3) -> DataFrame:
    """Links of weight ``least`` or more."""
    return links.where(F.col("weight") >= least)


def without_two_cycles(links: DataFrame) -> DataFrame:
    """Of a -> b and b -> a the lighter goes (of equals, the one that starts at the greater end)."""
    links = stored_once(links)
    one = both(links)
    back = one.select(F.col("c2").alias("c1"), F.col("s2").alias("s1"), F.col("c1").alias("c2"), F.col("s1").alias("s2"), F.col("weight").alias("w"))
    lighter = one.join(back, END).where((F.col("weight") < F.col("w")) | ((F.col("weight") == F.col("w")) & (F.struct("c1", "s1") > F.struct("c2", "s2"))))
    doomed = stored_once(lighter.select(*END)).distinct()
    return links.join(doomed, END, "left_anti")


def top_links(links: DataFrame, most: int) -> DataFrame:
    """The ``most`` heaviest links out of each end, seen from either side."""
    w = Window.partitionBy("c1", "s1").orderBy(F.desc("weight"), "c2", "s2")
    return both(links).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def light_links(links: DataFrame, percent: int = 5) -> DataFrame:
    """Links under a share of the weight of all links out of their end."""
    out = Window.partitionBy("c1", "s1")
    return both(links).withColumn("all", F.sum("weight").over(out)).where(F.col("weight") * 100 < F.col("all") * percent).select(*END)


def transitive(links: DataFrame, contigs: DataFrame, slack: int = 40, most: int = 3) -> DataFrame:
    """Links that a route of 2 to ``most`` other links explains: its length is the link's gap, give or take ``slack``."""
    one = both(links).select(*END, "gap")
    sizes = contigs.select(F.col("contig_id").alias("c"), F.col("len").cast("long").alias("clen"))
    longest = one.groupBy(F.col("c1").alias("a"), F.col("s1").alias("sa")).agg((F.max("gap") + slack).alias("limit"))
    walk = one.select(F.col("c1").alias("a"), F.col("s1").alias("sa"), F.col("c2").alias("b"), F.col("s2").alias("sb"), F.col("gap").alias("length"))
    found = None
    for _ in range(2, most + 1):
        step = one.select(F.col("c1").alias("b"), F.col("s1").alias("sb"), F.col("c2").alias("n"), F.col("s2").alias("sn"), F.col("gap").alias("more"))
        walk = walk.join(step, ["b", "sb"]).join(sizes, F.col("b") == F.col("c")).join(longest, ["a", "sa"])
        walk = walk.withColumn("length", F.col("length") + F.col("clen") + F.col("more")).where("length <= limit and (n <> a or sn <> sa)")
        walk = walk.select("a", "sa", F.col("n").alias("b"), F.col("sn").alias("sb"), "length").distinct()
        found = walk if found is None else found.unionByName(walk)
    hit = one.join(found.select(F.col("a").alias("c1"), F.col("sa").alias("s1"), F.col("b").alias("c2"), F.col("sb").alias("s2"), "length"), END)
    return stored_once(hit.where(F.abs(F.col("length") - F.col("gap")) <= slack).select(*END)).distinct()
