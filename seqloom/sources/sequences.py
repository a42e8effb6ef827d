"""Sequence files as tables, and tables as sequence files.

FASTA records are read through Spark's own text source with a line that begins with '>' as the separator, so
large files split. FASTQ lines are read by the same source and told apart by their place in the file. BAM files are decoded
a file a task, from their BGZF blocks.
All give (file, ord, name, seq); ord is the place in the file, from 0.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators.components import cut

#: Letters of the 4-bit codes that BAM packs sequences in (a fixed value of the format).
NIBBLES = "=ACMGRSVTWYHKDBN"
QC_FAIL = 0x200
#: The most bytes of a compressed block.
BLOCK = 1 << 16


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, seq) of FASTA records of one or many lines; '#' lines are skipped. A '>' begins a record at a line's start only; its name may be empty."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    first = F.regexp_replace("value", "^>", "")  # a file's first record has its sign still, unless comments stand before
    lines = F.filter(F.split(first, "\r?\n"), lambda x: ~x.startswith("#"))
    signed = F.col("value").startswith(">")
    rows = raw.select("file", "at", signed.alias("signed"), F.get(lines, F.lit(0)).alias("name"), F.array_join(F.slice(lines, 2, 1 << 30), "").alias("seq"))
    rows = rows.withColumn("name", F.split("name", r"\s")[0])
    rows = placed(rows, "file", "at", "ord")
    # What stands before a file's first record (comments, or all of a file without any) is a piece without a sign.
    none = F.broadcast(rows.where("ord = 0 and not signed").select("file", F.lit(1).alias("skip")))  # a row a file
    rows = rows.join(none, "file", "left").where("ord > 0 or signed")
    return rows.select("file", (F.col("ord") - F.coalesce("skip", F.lit(0))).alias("ord"), "name", "seq")


def placed(rows: DataFrame, file: str, at: str, name: str) -> DataFrame:
    """Adds a row's place among its file's, from 0: by Spark's row ids, which ascend along a file's splits."""
    split = F.shiftright(at, 33)
    rows = cut(rows.withColumn("__split", split))  # the ids hold only while nothing is read again
    sizes = rows.groupBy(file, "__split").agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__at"))
    before = Window.partitionBy(file).orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(file, "__split", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))  # a row a split
    nth = F.row_number().over(Window.partitionBy(file, "__split").orderBy(at)) - 1
    return rows.withColumn("__nth", nth).join(F.broadcast(first), [file, "__split"]).withColumn(name, F.col("__first") + F.col("__nth")).drop("__split", "__first", "__nth", at)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, seq) of FASTQ records of four lines; qualities are not kept, nor is an unfinished last record.

    Lines are read by Spark's own text source, so large files split: a line's place in its file says what it is, however its split began.
    """
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    lines = placed(raw, "file", "at", "line").withColumn("part", F.col("line") % 4)
    of = lambda n: F.max(F.when(F.col("part") == n, F.col("value")))
    records = lines.where("part < 2 or part = 3").groupBy("file", F.expr("line div 4").alias("ord"))
    rows = records.agg(of(0).alias("name"), of(1).alias("seq"), F.count_if(F.col("part") == 3).alias("ends")).where("ends = 1")
    return rows.select("file", "ord", F.split(F.substring("name", 2, 1 << 20), r"\s")[0].alias("name"), "seq")


def bam_records(data: bytes) -> Iterator[tuple[str, int, str]]:
    """(name, flag, sequence) of each alignment of a BAM file."""
    body, at = bytearray(), 0
    while at < len(data):
        inflate = zlib.decompressobj(31)
        body += inflate.decompress(data[at : at + BLOCK])
        while not inflate.eof and at + BLOCK < len(data):  # not a BGZF block: those are no longer
            at += BLOCK
            body += inflate.decompress(data[at : at + BLOCK])
        at += min(BLOCK, len(data) - at) - len(inflate.unused_data)
    if body[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", body, 4)[0]
    refs = struct.unpack_from("<i", body, at)[0]
    at += 4
    for _ in range(refs):
        at += 8 + struct.unpack_from("<i", body, at)[0]
    while at < len(body):
        size, _, _, name, _, _, cigars, flag, length = struct.unpack_from("<iiiBBHHHi", body, at)
        start = at + 36 + name + 4 * cigars
        packed = body[start : start + (length + 1) // 2]
        seq = "".join(NIBBLES[b >> 4] + NIBBLES[b & 15] for b in packed)[:length]
        yield body[at + 36 : at + 36 + name - 1].decode(), flag, seq
        at += 4 + size


def read_bam(spark: SparkSession, path: str, pairs: bool = True) -> DataFrame:
    """(file, ord, name, flag, seq); reads that fail quality checks go, with their mates if ``pairs``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows = list(bam_records(r.content))
                yield pd.DataFrame({"file": r.path, "ord": range(len(rows)), "name": [x[0] for x in rows], "flag": [x[1] for x in rows], "seq": [x[2] for x in rows]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(run, "file string, ord long, name string, flag int, seq string")
    failed = F.col("flag").bitwiseAND(QC_FAIL) > 0
    if not pairs:
        return out.where(~failed)
    bad = out.where(failed).select("file", F.expr("ord div 2").alias("pair")).distinct()
    return out.withColumn("pair", F.expr("ord div 2")).join(bad, ["file", "pair"], "left_anti").drop("pair")


def interleaved(one: DataFrame, two: DataFrame) -> DataFrame:
    """(read_id, mate, seq): mates of two files by their place; ids 2n + 1 and 2n + 2. A read without a mate stays, alone."""
    both = one.select("ord", F.col("seq").alias("s1")).join(two.select("ord", F.col("seq").alias("s2")), "ord", "full")
    mates = F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("s1").alias("seq")), F.struct(F.lit(2).alias("mate"), F.col("s2").alias("seq"))))
    return both.select("ord", mates.alias("m")).where("m.seq is not null").select((F.col("ord") * 2 + F.col("m.mate")).alias("read_id"), "m.mate", "m.seq")


def write_fasta(df: DataFrame, path: str, name: str, seq: str, width: int = 100) -> None:
    """Records with their sequence in lines of ``width``."""
    lines = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), lines).alias("value")).write.text(path)


def write_agp(rows: DataFrame, path: str) -> None:
    """AGP rows, tab-separated."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in rows.columns]
    rows.select(F.concat_ws("\t", *parts).alias("value")).write.text(path)
