"""Queries on reads, k-mers and sizes, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import kmers as K
from seqloom.operators import stats
from seqloom.operators.components import cut
from seqloom.plans import sql as Q

KMER = 23
LINK_COLUMNS = ", ".join(K.LINKS)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.reads_of(docs(spark, sf_dir), k=KMER)


def kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmer_table(reads(spark, sf_dir), KMER)


def _spelled(df: DataFrame) -> DataFrame:
    return df.withColumn("km", S.unpack(F.col("km"), KMER))


def fn1_normalize(spark, sf_dir):
    """Every text as bases (FN-1): length and digest."""
    s = S.bases(docs(spark, sf_dir).select("doc_id", "text"), "text")
    return s.select("doc_id", F.length("seq").cast("long").alias("n_bases"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def fn2_revcomp(spark, sf_dir):
    """Reverse complements (FN-2/3/10): digest, and whether the sequence is its canonical form."""
    s = S.bases(docs(spark, sf_dir).select(F.col("doc_id").alias("read_id"), "text"), "text", least=KMER + 1, strands=True)
    return s.select("read_id", F.md5(F.col("rc").cast("binary")).alias("rc_md5"), F.col("own").alias("is_canonical"), F.col("n_gc").cast("long").alias("gc"))


def fn5_roll(spark, sf_dir):
    """Benchmark texts as words rolled by a base in both directions (FN-5)."""
    s = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", S.normalize(F.col("text")).alias("seq")).where("seq <> ''")
    return s.select("item_id", S.next_kmer(F.col("seq"), F.lit("C")).alias("next_word"), S.prev_kmer(F.col("seq"), F.lit("G")).alias("prev_word"), S.canonical(F.col("seq")).alias("canonical_word"))


def src11_read_stats(spark, sf_dir):
    """Reads a library: count and extreme lengths (SRC-8/11, FLT-1)."""
    return reads(spark, sf_dir).groupBy("lib_id").agg(F.count(F.lit(1)).alias("n_reads"), F.min(F.length("seq")).cast("long").alias("min_len"), F.max(F.length("seq")).cast("long").alias("max_len"), F.sum(F.length("seq")).cast("long").alias("bases"))


def win2_windows(spark, sf_dir):
    """Windows of each read (WIN-2): how many, how many read as they are, and distinct ones."""
    return K.window_counts(reads(spark, sf_dir), KMER)


def agg1_kmer_table(spark, sf_dir):
    """Canonical k-mers with link counts (AGG-1)."""
    return K.kmer_table(reads(spark, sf_dir), KMER, spelled=True)


def agg3_kmer_freq(spark, sf_dir):
    """Histogram of k-mer coverage (AGG-3, SNK-1)."""
    return K.frequency(kmers(spark, sf_dir))


def flt2_rare_links(spark, sf_dir):
    """The table without links seen once (FLT-2), by what is left on each side."""
    t = K.marked(K.without_rare_links(kmers(spark, sf_dir), 1))
    return t.groupBy("n_left", "n_right").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("occurrences"))


def flt4_degrees(spark, sf_dir):
    """Branch degrees, linear and single k-mers (FLT-3/4)."""
    return K.marked(kmers(spark, sf_dir)).groupBy("n_left", "n_right", "linear", "single").agg(F.count(F.lit(1)).alias("n"))


def join2_neighbours(spark, sf_dir):
    """Each k-mer's links joined with the k-mers they lead to (JOIN-1/2): by k-mer."""
    many = kmers(spark, sf_dir).where(K.degree(K.LEFT) + K.degree(K.RIGHT) > 2)
    at = K.counts_of(cut(K.neighbours(many, KMER).select("km", "n", "nbr")), reads(spark, sf_dir), KMER)
    return _spelled(at.groupBy("km").agg(F.count(F.lit(1)).alias("links"), F.sum("nbr_cnt").alias("nbr_sum"), F.sum("n").cast("long").alias("weight")).where("links > 2"))


def agg4_branch_peaks(spark, sf_dir):
    """The largest neighbour of each branching side (AGG-4)."""
    return _spelled(K.branch_peaks(kmers(spark, sf_dir), KMER, reads(spark, sf_dir)))


def g1_local_filter(spark, sf_dir):
    """K-mers that the relative filter removes, at 40 percent (G-1)."""
    return _spelled(K.doomed_neighbours(kmers(spark, sf_dir), KMER, 40, reads(spark, sf_dir)))


def agg12_summary(spark, sf_dir):
    """Sizes of all reads in one row (AGG-12)."""
    return stats.summary(reads(spark, sf_dir).withColumn("size", F.length("seq")), "size")


def agg12_composition(spark, sf_dir):
    """Base composition and GC of all reads (AGG-12)."""
    return stats.composition(reads(spark, sf_dir), "seq")


def win1_nx(spark, sf_dir):
    """N10..N90 with ordinals (WIN-1, AGG-12/13)."""
    return stats.nx(reads(spark, sf_dir).withColumn("size", F.length("seq")), "size")


def agg15_weighted(spark, sf_dir):
    """Length-weighted mean (AGG-11/15), over line items."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return stats.weighted_mean(t, "l_suppkey", "l_discount", "l_quantity", "mean")


def agg10_insert(spark, sf_dir):
    """Trimmed mean and deviation (AGG-10), over event values."""
    return stats.trimmed_insert(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")


def win6_rank(spark, sf_dir):
    """Libraries ranked by the size class of their mean insert (WIN-6, SRC-1/17)."""
    from pyspark.sql import Window

    libs = reads(spark, sf_dir).groupBy("lib_id").agg(F.expr("cast(sum(length(seq)) div count(*) as bigint)").alias("avg_ins"))
    size = F.when(F.col("avg_ins") <= 300, 1).when(F.col("avg_ins") <= 800, 2).when(F.col("avg_ins") <= 3000, 3).when(F.col("avg_ins") <= 7000, 4).otherwise(5)
    return libs.withColumn("size_class", size).withColumn("rank", F.dense_rank().over(Window.orderBy("size_class")).cast("long"))  # one row a library


QUERIES = {f.__name__: f for f in (
    fn1_normalize, fn2_revcomp, fn5_roll, src11_read_stats, win2_windows, agg1_kmer_table, agg3_kmer_freq, flt2_rare_links, flt4_degrees,
    join2_neighbours, agg4_branch_peaks, g1_local_filter, agg12_summary, agg12_composition, win1_nx, agg15_weighted, agg10_insert, win6_rank,
)}

_T, _R = Q.table(KMER), f"WITH {Q.reads(KMER)}"
_MARK = f"SELECT *, {Q.degree('l')} AS n_left, {Q.degree('r')} AS n_right, cnt = 1 AS single FROM kmers"
_RARE = ", ".join(f"CASE WHEN {c} > 1 THEN {c} ELSE 0 END AS {c}" for c in K.LINKS)
_SIZES = "sizes AS (SELECT length(seq) AS size FROM reads WHERE length(seq) >= 100), h AS (SELECT size, count(*) AS n FROM sizes GROUP BY size)"
_NBR = f"{_T}, {Q.neighbours(KMER)}, hop AS (SELECT a.*, b.cnt AS nbr_cnt FROM nbrs a JOIN kmers b ON a.nbr = b.km), peaks AS (SELECT km, side, count(*) AS links, max(nbr_cnt) AS peak FROM hop GROUP BY km, side HAVING count(*) > 1)"

ORACLE_SQL = {
    "fn1_normalize": f"SELECT doc_id, length(s) AS n_bases, md5(s) AS seq_md5 FROM (SELECT doc_id, {Q.norm('text')} AS s FROM documents)",
    "fn2_revcomp": f"{_R} SELECT read_id, md5({Q.rc('seq')}) AS rc_md5, {Q.num('seq')} < {Q.num(Q.rc('seq'))} AS is_canonical, length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS gc FROM reads",
    "fn5_roll": f"SELECT item_id, substr(s, 2) || 'C' AS next_word, 'G' || left(s, length(s) - 1) AS prev_word, CASE WHEN {Q.num('s')} < {Q.num(Q.rc('s'))} THEN s ELSE {Q.rc('s')} END AS canonical_word FROM (SELECT item_id, {Q.norm('text')} AS s FROM benchmark) WHERE s <> ''",
    "src11_read_stats": f"{_R} SELECT lib_id, count(*) AS n_reads, min(length(seq)) AS min_len, max(length(seq)) AS max_len, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads GROUP BY lib_id",
    "win2_windows": f"{_T} SELECT read_id, count(*) AS n_windows, count(*) FILTER (fwd) AS n_forward, count(DISTINCT km) AS n_distinct, count(*) FILTER (l <> '') AS n_left FROM occ GROUP BY read_id",
    "agg1_kmer_table": f"{_T} SELECT * FROM kmers",
    "agg3_kmer_freq": f"{_T} SELECT CAST(CASE WHEN cnt = 1 THEN 1 ELSE least(255, greatest({Q.total('l')}, {Q.total('r')})) END AS BIGINT) AS bin, count(*) AS n FROM kmers GROUP BY 1",
    "flt2_rare_links": f"{_T}, rare AS (SELECT km, cnt, {_RARE} FROM kmers) SELECT {Q.degree('l')} AS n_left, {Q.degree('r')} AS n_right, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS occurrences FROM rare WHERE {Q.total('l')} + {Q.total('r')} > 0 GROUP BY 1, 2",
    "flt4_degrees": f"{_T} SELECT n_left, n_right, n_left = 1 AND n_right = 1 AS linear, single, count(*) AS n FROM ({_MARK}) GROUP BY 1, 2, 3, 4",
    "join2_neighbours": f"{_NBR} SELECT km, count(*) AS links, CAST(sum(nbr_cnt) AS BIGINT) AS nbr_sum, CAST(sum(n) AS BIGINT) AS weight FROM hop GROUP BY km HAVING count(*) > 2",
    "agg4_branch_peaks": f"{_NBR} SELECT * FROM peaks",
    "g1_local_filter": f"{_NBR} SELECT DISTINCT a.nbr AS km FROM hop a JOIN peaks p USING (km, side) WHERE a.nbr_cnt * 100 < p.peak * 40",
    "agg12_summary": f"{_R}, {_SIZES}, o AS (SELECT size, row_number() OVER (ORDER BY size) AS i, count(*) OVER () AS c FROM sizes) SELECT count(*) AS count, CAST(sum(size) AS BIGINT) AS total, CAST(sum(size) // count(*) AS BIGINT) AS mean, min(CASE WHEN i = (c + 1) // 2 THEN size END) AS median, min(size) AS least, max(size) AS most, "
    + ", ".join(f"count(*) FILTER (size > {c}) AS over_{c}" for c in stats.CLASSES) + " FROM o",
    "agg12_composition": f"{_R}, b AS (SELECT " + ", ".join(f"CAST(sum(length(seq) - length(replace(seq, '{c}', ''))) AS BIGINT) AS n_{c.lower()}" for c in "ACGTN") + " FROM reads WHERE length(seq) >= 100) SELECT *, round(100.0 * (n_g + n_c) / (n_a + n_c + n_g + n_t), 4) AS gc FROM b",
    "win1_nx": f"{_R}, {_SIZES}, o AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS i, sum(size) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sizes), p AS (SELECT unnest(range(10, 100, 10)) AS x) SELECT x, max(size) AS nx, min(i) AS lx FROM o, p WHERE upto >= ceil(total * x / 100.0) GROUP BY x",
    "agg15_weighted": "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_suppkey",
    "agg10_insert": "WITH f AS (SELECT event_type, count(value) AS c, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type HAVING count(value) >= 100) SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd FROM events JOIN f USING (event_type) WHERE abs(value - m) <= 3.0 * s GROUP BY event_type",
    "win6_rank": f"{_R}, a AS (SELECT lib_id, CAST(sum(length(seq)) // count(*) AS BIGINT) AS avg_ins FROM reads GROUP BY lib_id), b AS (SELECT *, CASE WHEN avg_ins <= 300 THEN 1 WHEN avg_ins <= 800 THEN 2 WHEN avg_ins <= 3000 THEN 3 WHEN avg_ins <= 7000 THEN 4 ELSE 5 END AS size_class FROM a) SELECT *, dense_rank() OVER (ORDER BY size_class) AS rank FROM b",
}
