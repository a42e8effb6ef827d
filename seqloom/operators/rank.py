"""Dense numbering and running totals of a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.components import cut


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Adds the place of each row in the order of some columns that no two rows share.

    Rows are range-partitioned; each partition is numbered apart, after the counts of those before it.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("__part").count()  # one row a partition
    offsets = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = parts.withColumn("__nth", nth).join(F.broadcast(offsets), "__part")
    out = out.withColumn(name, (F.col("__first") + F.col("__nth") + (start - 1)).cast("long")).drop("__part", "__first", "__nth")
    out._cut_path = parts._cut_path  # so that ``recut`` of the result by itself drops it
    return out
