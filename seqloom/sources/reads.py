"""Reads of all files of a configuration: opened by kind, cut to length, on one strand, in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.seq import normalize, oriented
from seqloom.sources import sequences as Q
from seqloom.sources.config import for_stage


def prepared(reads: DataFrame, k: int, cutoff: Column, reverse: Column) -> DataFrame:
    """Reads (lib_id, read_id, seq) as bases: cut to ``cutoff`` letters, complemented where ``reverse``; those under k + 1 go."""
    seq = normalize(F.col("seq"))
    out = reads.withColumn("seq", oriented(F.when(cutoff > 0, F.substring(seq, F.lit(1), cutoff.cast("int"))).otherwise(seq), reverse))
    return out.where(F.length("seq") >= k + 1).select("lib_id", "read_id", "seq")


def _numbered(df: DataFrame) -> DataFrame:
    return df.select((F.col("ord") + 1).alias("read_id"), "seq")


def _opened(spark: SparkSession, kind: str, one: str, two: str | None) -> DataFrame:
    """(read_id, seq) of a file or of two with mates; mates are 2n - 1 and 2n."""
    if kind == "f12":
        return Q.interleaved(Q.read_fasta(spark, one), Q.read_fasta(spark, two)).select("read_id", "seq")
    if kind == "q12":
        return Q.interleaved(Q.read_fastq(spark, one), Q.read_fastq(spark, two)).select("read_id", "seq")
    if kind == "b":
        return _numbered(Q.read_bam(spark, one))
    return _numbered(Q.read_fastq(spark, one) if kind == "q" else Q.read_fasta(spark, one))


def library_reads(spark: SparkSession, libs: DataFrame, k: int, scaffold: bool = False, pairs: bool = False) -> DataFrame:
    """(lib_id, file, read_id, seq) of all libraries of a stage; ``pairs`` leaves single files out.

    Reads are cut to the lesser of the library's and the configuration's greatest length.
    """
    parts = []
    for lib in for_stage(libs, scaffold).orderBy("lib_id").collect():  # a row a library
        longest = min(lib.rd_len_cutoff or lib.max_rd_len, lib.max_rd_len)
        for n, f in enumerate(lib.files):
            if pairs and f.kind in ("f", "q"):
                continue
            rows = _opened(spark, f.kind, f.path1, f.path2).withColumn("lib_id", F.lit(lib.lib_id))
            rows = prepared(rows, k, F.lit(longest), F.lit(bool(lib.reverse_seq)))
            parts.append(rows.select("lib_id", F.lit(n).alias("file"), "read_id", "seq"))
    if not parts:
        return spark.createDataFrame([], "lib_id int, file int, read_id long, seq string")
    return reduce(DataFrame.unionByName, parts)
