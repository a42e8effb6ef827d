"""Connected components of an undirected link table.

Alternates two star rewrites of the links until nothing changes. The large star
links each node's larger neighbours to the least node it knows; the small star links a
node and its smaller neighbours to the least of them. Every round keeps the
components, and chains shrink by a constant factor, so the number of rounds is
logarithmic. Hubs are no bottleneck: the least neighbour comes from a partial
aggregate, and the join back is an equi-join that adaptive execution may split.
Lineage is cut by a table in shared storage each round. A round has five shuffles, of at most two rows
a link: the driver keeps a record of each task and plan, and many rounds of small tables fill its memory.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: set it to a folder that driver and executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="seqloom-"))  # a single machine, as in tests
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once into a Parquet table in the checkpoint folder: cuts lineage, survives lost executors.

    What joins it then knows its size. A checkpoint keeps the estimate of the plan before, far too small for rows that Python
    tasks make, and whole tables of k-mers were broadcast. Shuffle files of the plan, which nothing reads any more, can go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def recut(df: DataFrame, old: DataFrame) -> DataFrame:
    """``cut``, and the table ``old`` of the round before, which nothing else may read, goes."""
    out = cut(df)
    dropped(old)
    return out


def dropped(old: DataFrame) -> None:
    """The table of a ``cut`` that nothing reads any more goes."""
    if path := getattr(old, "_cut_path", None):
        at = old.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(old.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has a link to another; ``component`` is the least node reachable.

    ``links`` may repeat rows and name a link in either direction; self links and
    links with a null end are ignored. An empty table gives an empty result. Nodes
    may be of any ordered type.
    """
    edges = cut(
        links.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    seen = fingerprint(edges)
    if seen[0] == 0:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(max_rounds):
        # Large star: the larger end is linked to the least node around the smaller one, which is no larger than that one.
        least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        large = edges.select(F.col("lo").alias("u"), "hi").join(least, "u", "left").select("hi", F.coalesce("m", "u").alias("m"))
        # Small star: each node and its smaller neighbours are linked to the least of them.
        stars = large.join(large.groupBy("hi").agg(F.min("m").alias("lo")), "hi")
        both = F.array(F.struct("hi", "lo"), F.struct(F.col("m").alias("hi"), "lo"))
        edges = recut(stars.select(F.inline(both)).where("hi <> lo").distinct(), edges)
        now = fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
