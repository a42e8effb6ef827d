"""Queries on contigs, mapping, links and loci, with their oracles.

The contigs are the distinct lines of ``documents``, the reads its whole texts; mates are the
two halves of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import links as L
from seqloom.operators import loci as T
from seqloom.operators import mapping as M
from seqloom.operators import stats
from seqloom.operators.components import cut
from seqloom.plans import sql as Q
from seqloom.plans.basics import KMER, docs, reads

UNIQUE = 100


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(M.contigs_of_lines(docs(spark, sf_dir), KMER))


def _placed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = contigs(spark, sf_dir)
    return M.placements(reads(spark, sf_dir), c, KMER), c


def _links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p, c = _placed(spark, sf_dir)
    return cut(L.read_links(p, c, KMER, UNIQUE)), c


def win5_contigs(spark, sf_dir):
    """Contigs renumbered by length and sequence (WIN-5, SRC-16, FLT-7, SNK-5)."""
    return contigs(spark, sf_dir).select("contig_id", "len", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), (F.col("len") + KMER >= UNIQUE).alias("is_unique"))


def join7_index(spark, sf_dir):
    """K-mers that occur once in all contigs (JOIN-7): by contig."""
    at = M.unique_kmers(contigs(spark, sf_dir), KMER)
    return at.groupBy("contig_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").cast("long").alias("pos_sum"), F.count_if("ctg_fwd").alias("forward"))


def map2_placements(spark, sf_dir):
    """Votes and placements of reads on contigs (AGG-8, MAP-2, SNK-8)."""
    return _placed(spark, sf_dir)[0]


def map3_best(spark, sf_dir):
    """The reported placement of each read (MAP-3)."""
    return M.best_placements(_placed(spark, sf_dir)[0]).select("read_id", "contig_id", "strand", "start", "votes")


def map4_gap_reads(spark, sf_dir):
    """Reads without a placement, laid by their mates' (MAP-4, GAP-1)."""
    p, c = _placed(spark, sf_dir)
    return M.gap_reads(M.best_placements(p), 2000, KMER, c)


def agg16_mapped(spark, sf_dir):
    """Mapped reads of each library (AGG-16)."""
    hit = _placed(spark, sf_dir)[0].groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    at = reads(spark, sf_dir).join(hit, "read_id", "left")
    return at.groupBy("lib_id").agg(F.count(F.lit(1)).alias("n_reads"), F.count("n").alias("mapped"), F.count_if(F.col("n") > 1).alias("on_many"))


def lnk4_read_links(spark, sf_dir):
    """Links by reads that run over two contigs (LNK-4, JOIN-9, AGG-9, SNK-12)."""
    return _links(spark, sf_dir)[0]


def _pairs(spark, sf_dir) -> DataFrame:
    half = F.expr("cast(length(seq) div 2 as int)")
    r = reads(spark, sf_dir).where(F.length("seq") >= 2 * KMER + 2)
    one = r.select((2 * F.col("read_id") + 1).alias("read_id"), F.left("seq", half).alias("seq"))
    two = r.select((2 * F.col("read_id") + 2).alias("read_id"), S.revcomp(F.expr("substring(seq, cast(length(seq) div 2 as int) + 1)")).alias("seq"))
    c = contigs(spark, sf_dir)
    best = M.best_placements(M.placements(one.unionByName(two), c, KMER)).join(c.select("contig_id", "len"), "contig_id")
    side = lambda parity, ids, strand, p, size: best.where(F.col("read_id") % 2 == parity).select(
        F.expr("(read_id - 1) div 2").alias("pair_id"), F.col("contig_id").alias(ids), F.col("strand").alias(strand), F.col("start").alias(p), F.col("len").alias(size)
    )
    insert = r.select(F.col("read_id").alias("pair_id"), "lib_id", F.length("seq").alias("insert_size"))
    pairs = side(1, "c1", "s1", "p1", "len1").join(side(0, "f", "fs", "p2", "len2"), "pair_id").join(insert, "pair_id")
    return L.pair_rows(pairs, KMER)


def lnk1_pairs(spark, sf_dir):
    """Status, gap and sampled insert of each pair (LNK-1, JOIN-8, AGG-16)."""
    return _pairs(spark, sf_dir).select("pair_id", "status", F.when(F.col("status") == "linked", F.col("gap")).alias("gap"), F.when(F.col("status") == "same_contig", F.col("sample")).alias("sample"))


def lnk2_pair_links(spark, sf_dir):
    """Links by pairs (LNK-2/3)."""
    return L.pair_links(_pairs(spark, sf_dir))


def _graded(spark, sf_dir) -> DataFrame:
    size = F.col("insert_size")
    return _pairs(spark, sf_dir).withColumn("grade", F.when(size <= 300, 1).when(size <= 800, 2).when(size <= 3000, 3).when(size <= 7000, 4).otherwise(5))


def lnk2_grades(spark, sf_dir):
    """Links by pairs of each insert grade apart (LNK-2)."""
    return L.pair_links_by_grade(_graded(spark, sf_dir))


def lnk3_merged(spark, sf_dir):
    """Links of all grades merged, palindromic contigs left out (LNK-3, SRC-18)."""
    palindromes = contigs(spark, sf_dir).where(F.col("seq") == S.revcomp(F.col("seq"))).select("contig_id")
    return L.merged_grades(L.pair_links_by_grade(_graded(spark, sf_dir)), palindromes)


def agg8_long_insert(spark, sf_dir):
    """Placements under the higher floor of long inserts (AGG-8)."""
    return M.placements(reads(spark, sf_dir), contigs(spark, sf_dir), KMER, insert=2000)


def _layout(spark, sf_dir) -> DataFrame:
    """Each contig in the first text that has it, laid along the text's other contigs."""
    lines = docs(spark, sf_dir).select(F.col("doc_id").alias("scaf"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    own = S.bases(lines, "line", least=KMER + 2, strands=True)  # shorter ones are no contigs
    at = own.select("scaf", "ord", F.when(F.col("own"), F.col("seq")).otherwise(F.col("rc")).alias("seq"), F.when(F.col("own"), "+").otherwise("-").alias("strand"))
    first = at.groupBy("seq").agg(F.min(F.struct("scaf", "ord", "strand")).alias("f")).join(contigs(spark, sf_dir), "seq")
    members = first.select(F.col("f.scaf").alias("locus_id"), F.lit(1).alias("iso"), F.col("f.ord").alias("ord"), "contig_id", F.col("f.strand").alias("strand"), F.lit(0).cast("long").alias("gap"), F.col("len").cast("long").alias("len"))
    return T.laid_out(members).withColumnRenamed("locus_id", "scaf").drop("iso", "gap")


def win7_layout(spark, sf_dir):
    """Contigs with their running offset along scaffolds (WIN-7, GAP-2)."""
    return _layout(spark, sf_dir)


def snk15_reads_on_scaffolds(spark, sf_dir):
    """Reads carried over from contigs to scaffolds (JOIN-10, SNK-15)."""
    return M.read_on_scaffolds(_placed(spark, sf_dir)[0], _layout(spark, sf_dir), KMER)


def t2_strong(spark, sf_dir):
    """Links of weight 2 and more (T-2)."""
    return L.strong(_links(spark, sf_dir)[0], 2)


def t4_two_cycles(spark, sf_dir):
    """Links without the lighter direction of two-cycles (T-4, G-11)."""
    return L.without_two_cycles(_links(spark, sf_dir)[0])


def t5_transitive(spark, sf_dir):
    """Links that a route over others explains (T-5, PATH-1)."""
    l, c = _links(spark, sf_dir)
    return L.transitive(L.strong(l, 2), c)


def t13_light(spark, sf_dir):
    """Links under a fifth of their end's weight (T-13, G-9/12)."""
    return L.light_links(_links(spark, sf_dir)[0], 20)


def lim2_top_links(spark, sf_dir):
    """The two heaviest links of each end (LIM-2, SET-1)."""
    return L.top_links(_links(spark, sf_dir)[0], 2)


def _strong(spark, sf_dir):
    l, c = _links(spark, sf_dir)
    return cut(L.without_two_cycles(L.strong(l, 2))), c


def t3_loci(spark, sf_dir):
    """Loci: components of the link graph (T-3, G-17)."""
    return T.loci(_strong(spark, sf_dir)[0])


def t6_conflicts(spark, sf_dir):
    """Contigs whose two strands are linked (T-6)."""
    return T.conflicts(_strong(spark, sf_dir)[0])


def t8_kinds(spark, sf_dir):
    """Kinds of loci by the links of their ends (T-8)."""
    l, _ = _strong(spark, sf_dir)
    return T.kinds(l, T.loci(l))


def _members(spark, sf_dir):
    l, c = _strong(spark, sf_dir)
    l = cut(T.without_conflicts(l))
    l = cut(T.without_loops(l, T.loci(l)))
    return T.transcripts(l, T.loci(l), c), c


def t12_transcripts(spark, sf_dir):
    """Transcripts of all loci (T-7, T-9..12, T-15, LIM-1, WIN-7)."""
    return _members(spark, sf_dir)[0]


def gap7_rendered(spark, sf_dir):
    """Sequences of all transcripts (GAP-7, SNK-14)."""
    m, c = _members(spark, sf_dir)
    return T.rendered(m, c, KMER).select("locus_id", "iso", F.length("seq").alias("size"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def gap7_agp(spark, sf_dir):
    """AGP rows of all transcripts (GAP-7, SNK-14)."""
    return T.agp(_members(spark, sf_dir)[0], KMER)


def join11_unplaced(spark, sf_dir):
    """Contigs that no link uses (JOIN-11)."""
    l, c = _links(spark, sf_dir)
    used = l.select(F.col("c1").alias("contig_id")).unionByName(l.select(F.col("c2").alias("contig_id")))
    return T.unplaced(c, used, KMER).select("contig_id", "len")


def agg14_rpkm(spark, sf_dir):
    """Expression of contigs by reads placed once (AGG-14, JOIN-10, SNK-17)."""
    p, c = _placed(spark, sf_dir)
    sizes = c.select(F.col("contig_id").alias("transcript_id"), (F.col("len") + KMER).alias("size"))
    return stats.rpkm(p.select("read_id", F.col("contig_id").alias("transcript_id")), sizes)


QUERIES = {f.__name__: f for f in (
    win5_contigs, join7_index, map2_placements, map3_best, map4_gap_reads, agg16_mapped, lnk4_read_links, lnk1_pairs, lnk2_pair_links, t2_strong,
    lnk2_grades, lnk3_merged, agg8_long_insert, win7_layout, snk15_reads_on_scaffolds,
    t4_two_cycles, t5_transitive, t13_light, lim2_top_links, t3_loci, t6_conflicts, t8_kinds, t12_transcripts, gap7_rendered, gap7_agp, join11_unplaced, agg14_rpkm,
)}

_CONTIGS = f"""lines AS (SELECT DISTINCT CASE WHEN {Q.num('s')} < {Q.num(Q.rc('s'))} THEN s ELSE {Q.rc('s')} END AS seq
        FROM (SELECT {Q.norm('line')} AS s FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE length(s) >= {KMER + 2}),
    contigs AS (SELECT row_number() OVER (ORDER BY length(seq), seq) AS contig_id, seq, CAST(length(seq) - {KMER} AS BIGINT) AS len FROM lines)"""
_INDEX = f"""{_CONTIGS}, {Q.occurrences('contigs', 'contig_id', KMER, 'cocc')},
    idx AS (SELECT km, min(contig_id) AS contig_id, min(j) AS pos, min(fwd) AS cfwd FROM cocc GROUP BY km HAVING count(*) = 1)"""


def _place(source: str, occ: str, name: str) -> str:
    return f"""{name}_v AS (SELECT o.read_id, i.contig_id, count(*) AS votes, min(o.j) AS read_off, arg_min(i.pos, o.j) AS pos, arg_min(o.fwd = i.cfwd, o.j) AS same
        FROM {occ} o JOIN idx i USING (km) GROUP BY 1, 2),
    {name} AS (SELECT v.read_id, v.contig_id, CASE WHEN same THEN '+' ELSE '-' END AS strand, read_off, CASE WHEN same THEN pos ELSE len - pos END AS ctg_off,
        CASE WHEN same THEN pos ELSE len - pos END - read_off AS start, votes
        FROM {name}_v v JOIN contigs USING (contig_id) JOIN {source} r USING (read_id) WHERE votes >= greatest(5, least(length(r.seq), 32) - {KMER} + 1))"""


_PLACED = f"WITH {Q.reads(KMER)}, {Q.occurrences('reads', 'read_id', KMER)}, {_INDEX}, {_place('reads', 'occ', 'placed')}"
_FLIP = "CASE WHEN {0} = '+' THEN '-' ELSE '+' END"
_ONCE = f"""SELECT CASE WHEN own THEN c1 ELSE c2 END AS c1, CASE WHEN own THEN s1 ELSE {_FLIP.format('s2')} END AS s1,
        CASE WHEN own THEN c2 ELSE c1 END AS c2, CASE WHEN own THEN s2 ELSE {_FLIP.format('s1')} END AS s2"""
_OWN = f"(c1, s1, c2, s2) <= (c2, {_FLIP.format('s2')}, c1, {_FLIP.format('s1')}) AS own"


def _merge(rows: str, name: str) -> str:
    return f"""{name} AS (SELECT c1, s1, c2, s2, CAST(trunc(sum(gap) / count(*)) AS BIGINT) AS gap, CAST(least(255, count(*)) AS INTEGER) AS weight
        FROM ({_ONCE}, gap FROM (SELECT *, {_OWN} FROM {rows})) GROUP BY 1, 2, 3, 4)"""


def _both(links: str, name: str) -> str:
    return f"{name} AS (SELECT c1, s1, c2, s2, gap, weight FROM {links} UNION SELECT c2, {_FLIP.format('s2')}, c1, {_FLIP.format('s1')}, gap, weight FROM {links})"


_LINKS = f"""{_PLACED},
    along AS (SELECT *, read_off + 1 - ctg_off AS p, lag(contig_id) OVER w AS pc, lag(strand) OVER w AS ps, lag(read_off + 1 - ctg_off) OVER w AS pp, lag(len) OVER w AS pl
        FROM placed JOIN (SELECT contig_id, len FROM contigs WHERE len + {KMER} >= {UNIQUE}) USING (contig_id) WINDOW w AS (PARTITION BY read_id ORDER BY read_off, contig_id)),
    steps AS (SELECT pc AS c1, ps AS s1, contig_id AS c2, strand AS s2, p - pp - pl AS gap FROM along WHERE pc IS NOT NULL AND pc <> contig_id AND p - pp - pl >= 0),
    {_merge('steps', 'links')}"""


def _cycles(links: str, name: str) -> str:
    return f"""{_both(links, name + '_b')},
    {name}_d AS (SELECT DISTINCT c1, s1, c2, s2 FROM ({_ONCE} FROM (SELECT a.*, {_OWN.replace('c1', 'a.c1').replace('c2', 'a.c2').replace('s1', 'a.s1').replace('s2', 'a.s2')} FROM {name}_b a JOIN {name}_b b ON a.c1 = b.c2 AND a.s1 = b.s2 AND a.c2 = b.c1 AND a.s2 = b.s1
        WHERE a.weight < b.weight OR (a.weight = b.weight AND (a.c1, a.s1) > (a.c2, a.s2))))),
    {name} AS (SELECT l.* FROM {links} l ANTI JOIN {name}_d USING (c1, s1, c2, s2))"""


_STRONG = f"{_LINKS}, heavy AS (SELECT * FROM links WHERE weight >= 2), {_cycles('heavy', 'strong')}".replace("WITH ", "WITH RECURSIVE ", 1)
_LOCI = f"""{_STRONG}, e AS (SELECT c1 AS a, c2 AS b FROM strong UNION SELECT c2, c1 FROM strong),
    walk AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.node),
    loci AS (SELECT node AS contig_id, min(root) AS locus_id FROM walk GROUP BY node)"""
_BEST = "best AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY CASE WHEN read_id % 2 = 1 THEN -read_off ELSE read_off END, contig_id) = 1)"
_PAIRS = f"""WITH {Q.reads(KMER, 'all_reads')}, long_reads AS (SELECT * FROM all_reads WHERE length(seq) >= {2 * KMER + 2}),
    reads AS (SELECT 2 * read_id + 1 AS read_id, left(seq, length(seq) // 2) AS seq FROM long_reads UNION ALL SELECT 2 * read_id + 2, {Q.rc('substr(seq, length(seq) // 2 + 1)')} FROM long_reads),
    {Q.occurrences('reads', 'read_id', KMER)}, {_INDEX}, {_place('reads', 'occ', 'placed')}, {_BEST},
    m AS (SELECT (read_id - 1) // 2 AS pair_id, read_id % 2 AS odd, best.*, len FROM best JOIN contigs USING (contig_id)),
    p AS (SELECT a.pair_id, a.contig_id AS c1, a.strand AS s1, a.start AS p1, a.len AS len1, b.contig_id AS f, b.strand AS fs, b.start AS p2, b.len AS len2, length(r.seq) AS ins
        FROM m a JOIN m b ON a.pair_id = b.pair_id AND a.odd = 1 AND b.odd = 0 JOIN long_reads r ON r.read_id = a.pair_id),
    g AS (SELECT *, ins - {KMER} + p1 + p2 - len1 - len2 AS gap FROM p),
    pairs AS (SELECT *, CASE WHEN c1 = f AND s1 = fs THEN 'wrong_orientation' WHEN c1 = f THEN 'same_contig' WHEN gap < -(ins // 10) THEN 'gap_too_small' WHEN gap > ins THEN 'gap_too_large' ELSE 'linked' END AS status FROM g)"""

_GRADES = f"""{_PAIRS}, graded AS (SELECT CASE WHEN ins <= 300 THEN 1 WHEN ins <= 800 THEN 2 WHEN ins <= 3000 THEN 3 WHEN ins <= 7000 THEN 4 ELSE 5 END AS grade, c1, s1, f AS c2, {_FLIP.format('fs')} AS s2, gap FROM pairs WHERE status = 'linked'),
    by_grade AS (SELECT grade, c1, s1, c2, s2, CAST(trunc(sum(gap) / count(*)) AS BIGINT) AS gap, CAST(least(255, count(*)) AS INTEGER) AS weight FROM ({_ONCE}, gap, grade FROM (SELECT *, {_OWN} FROM graded)) GROUP BY ALL)"""
_LAYOUT = f"""laid AS (SELECT doc_id AS scaf, i - 1 AS ord, {Q.norm('line')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    firsts AS (SELECT canon AS seq, min((scaf, ord, strand)) AS f FROM (SELECT scaf, ord, CASE WHEN {Q.num('s')} < {Q.num(Q.rc('s'))} THEN s ELSE {Q.rc('s')} END AS canon, CASE WHEN {Q.num('s')} < {Q.num(Q.rc('s'))} THEN '+' ELSE '-' END AS strand FROM laid) GROUP BY 1),
    layout AS (SELECT f[1] AS scaf, CAST(f[2] AS INTEGER) AS ord, contig_id, f[3] AS strand, len, CAST(coalesce(sum(len) OVER (PARTITION BY f[1] ORDER BY f[2] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM firsts JOIN contigs USING (seq))"""
_CARRIED = f"""carried AS (SELECT p.read_id, p.read_off, l.scaf, l.start, p.strand = l.strand AS same, CASE WHEN p.strand = l.strand THEN ctg_off ELSE l.len - ctg_off END AS off, votes FROM placed p JOIN layout l USING (contig_id)),
    left_over AS (SELECT *, CASE WHEN start > 0 THEN greatest(0, {KMER} - off) ELSE 0 END AS lost FROM carried)"""

ORACLE_SQL = {
    "lnk2_grades": f"{_GRADES} SELECT * FROM by_grade",
    "lnk3_merged": f"""{_GRADES}, pal AS (SELECT contig_id FROM contigs WHERE seq = {Q.rc('seq')})
        SELECT c1, s1, c2, s2, CAST(trunc(sum(gap * weight) / sum(weight)) AS BIGINT) AS gap, CAST(least(255, sum(weight)) AS INTEGER) AS weight, count(*) AS grades FROM by_grade WHERE c1 NOT IN (SELECT * FROM pal) AND c2 NOT IN (SELECT * FROM pal) GROUP BY 1, 2, 3, 4""",
    "agg8_long_insert": f"{_PLACED.replace('least(length(r.seq), 32)', 'least(length(r.seq), greatest(35, length(r.seq) // 2 + 1))')} SELECT * FROM placed",
    "win7_layout": f"WITH {_CONTIGS}, {_LAYOUT} SELECT scaf, ord, contig_id, strand, len, start FROM layout",
    "snk15_reads_on_scaffolds": f"{_PLACED}, {_LAYOUT}, {_CARRIED} SELECT read_id, read_off, scaf, CAST(start + off + lost AS BIGINT) AS scaf_pos, CASE WHEN same THEN '+' ELSE '-' END AS strand, CAST(votes + {KMER - 1} - lost AS BIGINT) AS align_len FROM left_over WHERE votes + {KMER - 1} - lost > 0",
    "win5_contigs": f"WITH {_CONTIGS} SELECT contig_id, CAST(len AS INTEGER) AS len, md5(seq) AS seq_md5, len + {KMER} >= {UNIQUE} AS is_unique FROM contigs",
    "join7_index": f"WITH {_INDEX} SELECT contig_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, count(*) FILTER (cfwd) AS forward FROM idx GROUP BY contig_id",
    "map2_placements": f"{_PLACED} SELECT * FROM placed",
    "map3_best": f"{_PLACED}, {_BEST} SELECT read_id, contig_id, strand, start, votes FROM best",
    "map4_gap_reads": f"""{_PLACED}, {_BEST}, lone AS (SELECT (read_id + 1) // 2 AS pair, min(read_id) AS id, min(contig_id) AS contig_id, min(strand) AS st, min(start) AS start FROM best GROUP BY 1 HAVING count(*) = 1)
        SELECT CASE WHEN id % 2 = 1 THEN id + 1 ELSE id - 1 END AS read_id, contig_id, {_FLIP.format('st')} AS strand, start + 2000 - len AS dis FROM lone JOIN contigs USING (contig_id)""",
    "agg16_mapped": f"{_PLACED}, hit AS (SELECT read_id, count(*) AS n FROM placed GROUP BY read_id) SELECT lib_id, count(*) AS n_reads, count(n) AS mapped, count(*) FILTER (n > 1) AS on_many FROM reads LEFT JOIN hit USING (read_id) GROUP BY lib_id",
    "lnk4_read_links": f"{_LINKS} SELECT * FROM links",
    "lnk1_pairs": f"{_PAIRS} SELECT pair_id, status, CASE WHEN status = 'linked' THEN gap END AS gap, CASE WHEN status = 'same_contig' THEN len1 + {KMER} - p1 - p2 END AS sample FROM pairs",
    "lnk2_pair_links": f"{_PAIRS}, linked AS (SELECT c1, s1, f AS c2, {_FLIP.format('fs')} AS s2, gap FROM pairs WHERE status = 'linked'), {_merge('linked', 'links')} SELECT * FROM links",
    "t2_strong": f"{_LINKS} SELECT * FROM links WHERE weight >= 2",
    "t4_two_cycles": f"{_LINKS}, {_cycles('links', 'kept')} SELECT * FROM kept",
    "t5_transitive": f"""{_LINKS}, heavy AS (SELECT * FROM links WHERE weight >= 2), {_both('heavy', 'b')},
        two AS (SELECT x.c1, x.s1, y.c2, y.s2, x.gap + len + y.gap AS length FROM b x JOIN b y ON x.c2 = y.c1 AND x.s2 = y.s1 JOIN contigs ON contig_id = x.c2 WHERE (y.c2, y.s2) <> (x.c1, x.s1)),
        three AS (SELECT x.c1, x.s1, y.c2, y.s2, x.length + len + y.gap AS length FROM two x JOIN b y ON x.c2 = y.c1 AND x.s2 = y.s1 JOIN contigs ON contig_id = x.c2 WHERE (y.c2, y.s2) <> (x.c1, x.s1)),
        hit AS (SELECT b.* FROM b JOIN (SELECT * FROM two UNION SELECT * FROM three) r USING (c1, s1, c2, s2) WHERE abs(r.length - b.gap) <= 40)
        SELECT DISTINCT c1, s1, c2, s2 FROM ({_ONCE} FROM (SELECT *, {_OWN} FROM hit))""",
    "t13_light": f"{_LINKS}, {_both('links', 'b')} SELECT c1, s1, c2, s2 FROM (SELECT *, sum(weight) OVER (PARTITION BY c1, s1) AS a FROM b) WHERE weight * 100 < a * 20",
    "lim2_top_links": f"{_LINKS}, {_both('links', 'b')} SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY c1, s1 ORDER BY weight DESC, c2, s2) <= 2",
    "t3_loci": f"{_LOCI} SELECT * FROM loci",
    "t6_conflicts": f"""{_STRONG}, {_both('strong', 'b')}, e AS (SELECT c1 || s1 AS a, c2 || s2 AS b FROM b UNION SELECT c2 || s2, c1 || s1 FROM b),
        walk AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.node)
        SELECT DISTINCT CAST(left(node, length(node) - 1) AS BIGINT) AS contig_id FROM walk WHERE left(node, length(node) - 1) = left(root, length(root) - 1) AND node <> root""",
    "t8_kinds": f"""{_LOCI}, {_both('strong', 'b')}, n AS (SELECT locus_id, contig_id, st, (SELECT count(*) FROM b WHERE c1 = contig_id AND s1 = st) AS n FROM loci, (VALUES ('+'), ('-')) v(st)),
        d AS (SELECT locus_id, count(DISTINCT contig_id) AS contigs, count(*) FILTER (n = 0) AS none, count(*) FILTER (n = 2) AS two, count(*) FILTER (n > 2) AS more FROM n GROUP BY locus_id)
        SELECT *, CASE WHEN contigs <= 2 OR (none, two, more) = (2, 0, 0) THEN 'LINEAR' WHEN (none, two, more) = (3, 1, 0) THEN 'FORK' WHEN (none, two, more) = (2, 2, 0) THEN 'BUBBLE' ELSE 'COMPLEX' END AS kind FROM d""",
    "join11_unplaced": f"{_LINKS} SELECT contig_id, CAST(len AS INTEGER) AS len FROM contigs WHERE len + {KMER} >= 100 AND contig_id NOT IN (SELECT c1 FROM links UNION SELECT c2 FROM links)",
    "agg14_rpkm": f"""{_PLACED}, u AS (SELECT read_id, min(contig_id) AS contig_id FROM placed GROUP BY read_id HAVING count(*) = 1), t AS (SELECT count(*) AS a FROM u), h AS (SELECT contig_id, count(*) AS n FROM u GROUP BY 1)
        SELECT contig_id AS transcript_id, len + {KMER} AS size, coalesce(n, 0) AS uniq_reads, round(CASE WHEN a > 0 THEN coalesce(n, 0) * 1e9 / (a * (len + {KMER})) ELSE 0.0 END, 4) AS rpkm FROM contigs LEFT JOIN h USING (contig_id), t""",
}
