"""K-mers in blocks against plain windows; byte translation of texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import blocks as B
from seqloom.operators import kmers as K
from seqloom.operators import mapping as M


def some_reads(n: int = 40, seed: int = 1) -> list[bytes]:
    pick = random.Random(seed)
    return [bytes(pick.choice(b"ACTGACTGACTGN") for _ in range(pick.choice([0, 5, 23, 24, 60, 900, 3000]))) for _ in range(n)] + [b"A" * 2000, b"ACTG" * 100]


@pytest.mark.parametrize("k", [13, 17, 19, 23, 29, 31])
def test_blocks_hold_all_windows_and_a_kmer_has_one_bucket(k):
    reads = some_reads()
    found, bucket = [], {}
    for at, block in zip(*B.packed(reads, k, np.arange(len(reads)))):
        w = B.Windows([block], k, True)
        found += zip(w.read.tolist(), w.place.tolist(), w.km.tolist(), w.fwd.tolist(), w.left.tolist(), w.right.tolist())
        assert all(bucket.setdefault(km, at) == at for km in w.km.tolist())
    assert sorted(found) == sorted(zip(*(x.tolist() for x in K.windows(reads, k))))


def test_blocks_take_few_bytes():
    pick = random.Random(3)
    reads = [bytes(pick.choices(b"ACTG", k=2000)) for _ in range(500)]
    _, data = B.packed(reads, 23)
    assert sum(map(len, data)) < 2 * sum(len(r) - 22 for r in reads)


@pytest.mark.parametrize("k", [13, 23, 31])
def test_table_adds_up_over_batches_and_chunks(spark, k):
    reads = some_reads(60, 7) * 3
    df = spark.createDataFrame([(r.decode(),) for r in reads], "seq string").repartition(5)
    _, _, km, _, left, right = K.windows(reads, k)
    count, links = Counter(km.tolist()), defaultdict(Counter)
    for c, l, r in zip(km.tolist(), left.tolist(), right.tolist()):
        links[c].update((f"l{l}", f"r{r}"))
    got = {r.km: r for r in K.kmer_table(df, k).collect()}
    assert {c: r.cnt for c, r in got.items()} == count
    assert all(got[c][name] == min(63, links[c][name]) for c in got for name in K.LINKS)


def test_window_counts_of_repeated_and_missing_ids(spark):
    reads = [r.decode() for r in some_reads(80, 9)]
    rows = [(None if n % 17 == 0 else n % 50, r) for n, r in enumerate(reads)]
    df = spark.createDataFrame(rows, "read_id long, seq string").repartition(7)
    o = K.occurrences(df, 23).groupBy("read_id").agg(F.count("*").alias("w"), F.count_if("fwd").alias("f"), F.count_distinct("km").alias("d"), F.count_if(F.col("l") < 4).alias("n"))
    out = K.window_counts(df, 23)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, o.collect()))


def test_votes_are_those_of_all_windows(spark):
    pick = random.Random(5)
    genome = "".join(pick.choices("ACTG", k=4000))
    contigs = spark.createDataFrame([(n, genome[n * 300 : n * 300 + 330]) for n in range(12)] + [(20, genome[:100])], "contig_id long, seq string")
    flip = str.maketrans("ACTG", "TGAC")
    reads = [(n, (lambda s: s[::-1].translate(flip) if n % 2 else s)(genome[n * 90 : n * 90 + 700])) for n in range(40)] + [(None, genome[:500])]
    df = spark.createDataFrame(reads, "read_id long, seq string")
    hits = K.occurrences(df, 23).where("read_id is not null").join(M.unique_kmers(contigs, 23), "km")
    want = hits.groupBy("read_id", "contig_id").agg(F.count("*").alias("votes"), F.min(F.struct("j", "pos", (F.col("fwd") == F.col("ctg_fwd")).alias("same"))).alias("first"))
    occ = K.occurrences(contigs.withColumnRenamed("contig_id", "read_id"), 23).groupBy("km").count().where("count = 1")
    assert M.unique_kmers(contigs, 23).count() == occ.count()
    assert set(map(tuple, M.votes(df, contigs, 23).collect())) == set(map(tuple, want.collect()))


def test_bases_are_those_of_spark_functions(spark):
    texts = ["acgN.x-1Z", "", None, "Zażółć\ngęślą jaźń. ſK", "A" * 30, "hello, World."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    norm = S.normalize(F.col("text"))
    want = df.select("id", norm.alias("seq"), S.revcomp(norm), S.is_canonical(norm), S.gc(norm)).collect()
    assert list(map(tuple, S.bases(df, "text", strands=True).collect())) == list(map(tuple, want))
    assert [r.id for r in S.bases(df, "text", least=7).collect()] == [0, 3, 4, 5]
