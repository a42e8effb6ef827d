"""A running k-mer histogram over a stream of reads, batch by batch (an extension of the batch counters)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.kmers import kmer_table


def count_stream(reads: DataFrame, k: int, table: str, checkpoint: str):
    """Start a query that appends each batch's k-mer counts to ``table`` (Parquet); one batch number is written once."""

    def add(batch: DataFrame, number: int) -> None:
        kmer_table(batch, k).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(table: DataFrame) -> DataFrame:
    """(km, cnt) over all batches."""
    return table.groupBy("km").agg(F.sum("cnt").alias("cnt"))
