"""Readers and writers, by round trips."""

import struct
import zlib

from seqloom.operators import kmers as K
from seqloom.sources import config
from seqloom.sources import sequences as Q
from seqloom.sources.reads import library_reads
from seqloom.streaming.kmers import count_stream, totals


def test_config(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("max_rd_len=90\n[LIB]\navg_ins=500\nq1=a\nq2=b\n# no\n[LIB]\navg_ins=200\nrd_len_cutof=50\nasm_flags=2\nf=x\np=y\n")
    rows = config.libraries(spark, str(p)).collect()
    assert [(r.avg_ins, r.max_rd_len, r.rd_len_cutoff, r.asm_flags) for r in rows] == [(200, 90, 50, 2), (500, 90, 0, 3)]
    assert [tuple(f) for f in rows[1].files] == [("q12", "a", "b")]
    assert config.for_stage(config.libraries(spark, str(p)), scaffold=False).count() == 1


def test_fasta(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 60), ("b", "GG")], "name string, seq string")
    Q.write_fasta(df, str(tmp_path / "out"), "name", "seq")
    got = {r.name: r.seq for r in Q.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": "ACGT" * 60, "b": "GG"}


def test_fasta_records_without_a_name_or_a_mate(spark, tmp_path):
    (tmp_path / "a.fa").write_text("#c\n>\nACGT\n>b\nGG\n>\n>c\nTT\n")
    (tmp_path / "b.fa").write_text("#only\n#comments\n")
    (tmp_path / "c.fa").write_text(">x\nCC\n")
    read = lambda n: Q.read_fasta(spark, str(tmp_path / n))
    assert [(r.ord, r.name, r.seq) for r in read("a.fa").orderBy("ord").collect()] == [(0, "", "ACGT"), (1, "b", "GG"), (2, "", ""), (3, "c", "TT")]
    assert read("b.fa").count() == 0
    got = Q.interleaved(read("a.fa"), read("c.fa")).orderBy("read_id").collect()
    assert [(r.read_id, r.seq) for r in got] == [(1, "ACGT"), (2, "CC"), (3, "GG"), (5, ""), (7, "TT")]


def test_fastq_pairs(spark, tmp_path):
    for n, s in (("1", "ACGT"), ("2", "TTGG")):
        (tmp_path / f"{n}.fq").write_text("".join(f"@r{i}/{n}\n{s * (i + 1)}\n+\n{'I' * 4 * (i + 1)}\n" for i in range(3)))
    one, two = (Q.read_fastq(spark, str(tmp_path / f"{n}.fq")) for n in "12")
    got = [(r.read_id, r.mate, r.seq) for r in Q.interleaved(one, two).orderBy("read_id").collect()]
    assert got[:3] == [(1, 1, "ACGT"), (2, 2, "TTGG"), (3, 1, "ACGTACGT")] and len(got) == 6


def test_fastq_of_many_splits(spark, tmp_path):
    # Qualities that look like names or separators, ends of both kinds, an unfinished record.
    records = [(f"r{i} x", "ACGT" * (i % 7 + 1), "@+@+" * (i % 7 + 1)) for i in range(3000)]
    (tmp_path / "a.fq").write_bytes("".join(f"@{n}\n{s}\n+{n if i % 3 else ''}\n{q}{chr(13) if i % 2 else ''}\n" for i, (n, s, q) in enumerate(records)).encode() + b"@last\nACGT\n+\n")
    (tmp_path / "b.fq").write_text("@one\nAC\n+\nII\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > 10
        got = Q.read_fastq(spark, str(tmp_path)).orderBy("file", "ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.ord, r.name, r.seq) for r in got] == [(i, f"r{i}", s) for i, (_, s, _) in enumerate(records)] + [(0, "one", "AC")]


def test_reads_of_a_configuration(spark, tmp_path):
    (tmp_path / "a.fa").write_text("#c\n>a len>5 x\nACGTACGTAC\nGTAC\n>b\nGGGG\n" + "".join(f">n{i}\n{'ACTG' * 5}\n" for i in range(50)))
    (tmp_path / "1.fq").write_text("@r/1\nAACCGGTTAACCGGTT\n+\nIIII\n")
    (tmp_path / "2.fq").write_text("@r/2\nTTTTTTTTTTTTTTTT\n+\nIIII\n")
    (tmp_path / "c.txt").write_text(f"max_rd_len=15\n[LIB]\navg_ins=100\nreverse_seq=1\nrd_len_cutoff=14\nf={tmp_path}/a.fa\n[LIB]\navg_ins=200\nq1={tmp_path}/1.fq\nq2={tmp_path}/2.fq\n")
    libs = config.libraries(spark, str(tmp_path / "c.txt"))
    got = sorted((r.lib_id, r.read_id, r.seq) for r in library_reads(spark, libs, 13).collect())
    assert got[0] == (0, 1, "GTACGTACGTACGT") and len(got) == 53 and [x[1] for x in got[1:51]] == list(range(3, 53))
    assert got[51:] == [(1, 1, "AACCGGTTAACCGGT"), (1, 2, "T" * 15)]
    assert library_reads(spark, libs, 13, pairs=True).count() == 2
    fasta = Q.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()
    assert [(r.ord, r.name, r.seq) for r in fasta[:2]] == [(0, "a", "ACGTACGTACGTAC"), (1, "b", "GGGG")] and [r.ord for r in fasta] == list(range(52))


def _bam(rows):
    body = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 0)
    for name, flag, seq in rows:
        codes = [Q.NIBBLES.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        rec = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + b"\xff" * len(seq)
        body += struct.pack("<i", len(rec)) + rec
    out = b""
    for at in range(0, len(body), 50):
        c = zlib.compressobj(wbits=31)
        out += c.compress(body[at : at + 50]) + c.flush()
    return out


def test_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(_bam([("r1", 0, "ACGTN"), ("r1", 0, "GG"), ("r2", 0x200, "AAAA"), ("r2", 0, "CC")]))
    assert [r.seq for r in Q.read_bam(spark, str(tmp_path / "x.bam")).orderBy("ord").collect()] == ["ACGTN", "GG"]
    assert Q.read_bam(spark, str(tmp_path / "x.bam"), pairs=False).count() == 3


def test_stream_counts_like_a_batch(spark, tmp_path):
    rows = [(i, "a", ("ACGTTGCA" * 5)[i:] + "ACCA" * i) for i in range(6)]
    df = spark.createDataFrame(rows, "read_id long, lib_id string, seq string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    count_stream(stream, 13, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.km, r.cnt) for r in totals(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {(r.km, r.cnt) for r in K.kmer_table(df, 13).select("km", "cnt").collect()}
