"""Gap filling: reads near gaps, and a local assembly of each gap."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of the contigs on either side that a local assembly starts from.
FLANK = 35
#: Routes and steps that a gap's search may take.
ROUTES, STEPS = 10, 5000


def reads_in_gaps(reads: DataFrame, gaps: DataFrame, width: int = 1000, margin: int = 100) -> DataFrame:
    """(scaf, gap_id, read_id): reads (scaf, read_id, dis, len) that overlap a gap (scaf, gap_id, beg, end), give or take a margin.

    An interval join as an equi-join: both sides list the stretches of ``width`` bases that
    they touch; a pair counts in the first that both do.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    g = gaps.select("scaf", "gap_id", (F.col("beg") - margin).alias("gb"), (F.col("end") + margin).alias("ge"))
    g = g.withColumn("cell", cells(F.col("gb"), F.col("ge")))
    r = reads.select("scaf", "read_id", F.col("dis").alias("rb"), (F.col("dis") + F.col("len")).alias("re"))
    r = r.withColumn("cell", cells(F.col("rb"), F.col("re")))
    hit = r.join(g, ["scaf", "cell"]).where((F.col("rb") <= F.col("ge")) & (F.col("re") >= F.col("gb")))
    first = F.floor(F.greatest("rb", "gb") / width)
    return hit.where(F.col("cell") == first).select("scaf", "gap_id", "read_id")


def fill(left: str, right: str, reads: list[str], gap: int, k: int, slack: int = 50) -> str | None:
    """Bases between two flanks by a walk over the reads' k-mers, of a length within ``slack`` of the gap.

    Of several routes the one whose k-mers are seen most on average is taken; a shorter k is tried
    where none is found, down to 15.
    """
    while k > 14:
        if len(left) >= k and len(right) >= k:
            seen = Counter(s[i : i + k] for s in (*reads, left, right) for i in range(len(s) - k + 1))
            goal, best, steps, routes = right[:k], None, 0, 0
            stack = [(left[-k:], "", 0)]
            while stack and steps < STEPS and routes < ROUTES:
                steps += 1
                word, path, weight = stack.pop()
                if word == goal and len(path) >= k and abs(len(path) - k - gap) <= slack:
                    routes += 1
                    best = max(best or (0, ""), (weight / len(path), path[: len(path) - k]))
                    continue
                if len(path) - k > gap + slack:
                    continue
                for b in "ACTG":
                    n = seen.get(word[1:] + b)
                    if n:
                        stack.append((word[1:] + b, path + b, weight + n))
            if best:
                return best[1]
        k -= 2
    return None


def filled(gaps: DataFrame, near: DataFrame, k: int, slack: int = 50) -> DataFrame:
    """(gap_id, fill): gaps (gap_id, left_seq, right_seq, gap) with their reads (gap_id, seq); null where none is found."""
    rows = gaps.select("gap_id", F.right("left_seq", F.lit(FLANK)).alias("l"), F.left("right_seq", F.lit(FLANK)).alias("r"), "gap", F.lit(None).cast("string").alias("seq"))
    rows = rows.unionByName(near.select("gap_id", "seq"), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.seq.isna()]
        if own.empty:
            return pd.DataFrame({"gap_id": [], "fill": []})
        o = own.iloc[0]
        return pd.DataFrame({"gap_id": [o.gap_id], "fill": [fill(o.l, o.r, pdf.seq.dropna().tolist(), int(o.gap), k, slack)]})

    return rows.groupBy("gap_id").applyInPandas(run, "gap_id long, fill string")
