"""Queries on the unitig graph of all conversations (k = 13, where it branches): edges, paths, arcs, cleaners, contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.seq import bases, unpack
from seqloom.operators import bubbles as B
from seqloom.operators import contigs as C
from seqloom.operators import edges as E
from seqloom.operators import kmers as K
from seqloom.operators import routes as R
from seqloom.operators import tracks as A
from seqloom.operators import unitigs as U
from seqloom.operators.compact import Edges
from seqloom.operators.components import cut
from seqloom.plans import sql as Q

SIZE = 13


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return bases(t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), F.col("role").alias("lib_id"), F.col("text").alias("seq")), "seq", least=SIZE + 1)


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns, and every third one once more with its middle base changed, as from a second allele: a bubble each."""
    t = turns(spark, sf_dir)
    half = F.expr("cast(length(seq) div 2 as int)")
    other = F.concat(F.left("seq", half), F.translate(F.substring(F.col("seq"), half + 1, F.lit(1)), "ACTG", "CAGT"), F.substring(F.col("seq"), half + 2, F.lit(1 << 30)))
    return t.unionByName(t.where("read_id % 3 = 0").select((-F.col("read_id") - 1).alias("read_id"), "lib_id", other.alias("seq")))


def _table(spark, sf_dir) -> DataFrame:
    return cut(K.kmer_table(turns(spark, sf_dir), SIZE))


def _edges(spark, sf_dir, reads=turns) -> Edges:
    return Edges(cut(K.kmer_table(reads(spark, sf_dir), SIZE)), SIZE)


def _arcs(spark, sf_dir, keep=None) -> DataFrame:
    return A.arcs(_edges(spark, sf_dir), turns(spark, sf_dir), keep)


def _graph(spark, sf_dir, reads=turns) -> tuple[DataFrame, DataFrame]:
    """Edges, and the arcs that reads walk."""
    e = _edges(spark, sf_dir, reads)
    return e.rows(), cut(A.arcs(e, reads(spark, sf_dir)).select("e1", "e2", "multiplicity"))


def _directed(edges: DataFrame) -> DataFrame:
    return U.oriented(edges).select(F.col("oe").alias("edge_id"), "src", "dst", "len", "cvg10")


def snk2_edges(spark, sf_dir):
    """Unitigs as numbered edges (G-4, AGG-5, SNK-2, SRC-14): spelling, coverage, palindromes."""
    return _edges(spark, sf_dir).rows().select("edge_id", "len", "cvg10", "seq", "is_palindrome")


def snk3_vertices(spark, sf_dir):
    """The k-mers that edges begin and end at (SNK-3, SRC-13)."""
    return U.vertices(_table(spark, sf_dir)).select(unpack(F.col("km"), SIZE).alias("km"))


def snk3_graph_stats(spark, sf_dir):
    """One row: vertices, k, longest and shortest read (SNK-3)."""
    n = U.vertices(_table(spark, sf_dir)).agg(F.count(F.lit(1)).alias("vertices"))
    r = turns(spark, sf_dir).agg(F.max(F.length("seq")).cast("long").alias("max_len"), F.min(F.length("seq")).cast("long").alias("min_len"), F.count(F.lit(1)).alias("n_reads"))
    return n.join(F.broadcast(r)).withColumn("k", F.lit(SIZE))


def g2_single_tips(spark, sf_dir):
    """K-mers of tips that were seen once (G-2)."""
    return U.tips(_table(spark, sf_dir), SIZE, single=True).select(unpack(F.col("km"), SIZE).alias("km"))


def g3_minor_tips(spark, sf_dir):
    """K-mers of weak or isolated tips (G-3), one round."""
    return U.tips(_table(spark, sf_dir), SIZE).select(unpack(F.col("km"), SIZE).alias("km"))


def flt5_unlinked(spark, sf_dir):
    """The table without tips, and their links gone from what stays (FLT-5)."""
    t = _table(spark, sf_dir)
    out = U.without_tips(t, SIZE, rounds=1)
    return out.select(unpack(F.col("km"), SIZE).alias("km"), "cnt", *K.LINKS)


def g5_read_paths(spark, sf_dir):
    """The edges that each read runs along (G-5, MAP-1, JOIN-1/3, FLT-6, WIN-3)."""
    return A.read_paths(_edges(spark, sf_dir), turns(spark, sf_dir), whole=True)


def snk4_arcs(spark, sf_dir):
    """Arcs between edges that reads join, with their mirrors (SNK-4, AGG-6/7, G-5, SRC-15, WIN-4, SET-1)."""
    return _arcs(spark, sf_dir).select("e1", "e2", "multiplicity")


def g7_weak_edges(spark, sf_dir):
    """Edges of the graph over a coverage cutoff (G-7)."""
    return E.strong_edges(_directed(_edges(spark, sf_dir).rows()), 20).select("edge_id", "len", "cvg10")


def g8_graph_tips(spark, sf_dir):
    """Edges of the graph that aren't tips (G-8)."""
    e = _edges(spark, sf_dir)
    return _directed(e.rows().join(e.tips(2 * SIZE), "edge_id", "left_anti")).select("edge_id", "len", "cvg10")


def g9_graph_arcs(spark, sf_dir):
    """Arcs of the graph that aren't negligible on either side (G-9)."""
    return _arcs(spark, sf_dir, A.likely(30, 1)).select("e1", "e2", "multiplicity")


def g10_graph_arcs(spark, sf_dir):
    """Arcs of the graph that no heavy one overshadows (G-10)."""
    return _arcs(spark, sf_dir, A.not_overshadowed(4, 50)).select("e1", "e2", "multiplicity")


def g11_graph_loops(spark, sf_dir):
    """Arcs of the graph without self loops and two-cycles (G-11)."""
    return A.without_loops(cut(_arcs(spark, sf_dir)))


def g13_graph_short(spark, sf_dir):
    """Short edges of the graph without any arc (G-13)."""
    e = _edges(spark, sf_dir)
    used = A.arcs(e, turns(spark, sf_dir), A.one_each).select(F.shiftright("e1", 1).alias("edge_id")).distinct()
    alone = e.rows().where(F.col("len") <= 48).select("edge_id", "is_palindrome").join(used, "edge_id", "left_anti")
    return alone.select(F.explode(F.when(F.col("is_palindrome"), F.array(F.col("edge_id") * 2)).otherwise(F.array(F.col("edge_id") * 2, F.col("edge_id") * 2 + 1))).alias("oe"))


def g14_graph_joins(spark, sf_dir):
    """Edges of the graph that only follow each other (G-14), first round."""
    return A.joins(_edges(spark, sf_dir), turns(spark, sf_dir))


def _two_alleles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e, a = _graph(spark, sf_dir, alleles)
    return cut(C.spelled(e, U.oriented(e))), a


def g6_bubble_pairs(spark, sf_dir):
    """Paths of several edges that a faster path may take up (G-6, FN-13): shortest times and alignments over the whole graph, first round."""
    found = B.pairs(B.labels(*_two_alleles(spark, sf_dir), SIZE), SIZE)
    name = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("s", "t", name("slow"), name("fast"), "weight", "size", "weak")


def g6_pinched(spark, sf_dir):
    """Edges of the graph after all bubbles are merged (G-6, G-6a)."""
    edges, _ = B.pinched(*_two_alleles(spark, sf_dir), SIZE)
    return edges.select("oe", "len", "cvg10", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def path2_arc_routes(spark, sf_dir):
    """Routes of up to 4 arcs between edges that two arcs join (PATH-2), with their number."""
    e, a = _graph(spark, sf_dir)
    two = a.select(F.col("e1").alias("a"), F.col("e2").alias("m")).join(a.select(F.col("e1").alias("m"), F.col("e2").alias("b")), "m")
    searches = two.select("a", "b").distinct().select(F.struct("a", "b").alias("search"), "a", "b", F.lit(10).alias("low"), F.lit(40).alias("high"))
    found = R.limited(R.arc_routes(searches, a, U.oriented(e).select(F.col("oe").alias("e"), "len"), 4))
    return found.select("search.a", "search.b", F.array_join(F.col("route").cast("array<string>"), ",").alias("route"), "length", F.col("n_routes"))


def _contigs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e, a = _graph(spark, sf_dir)
    return C.cleaned(C.spelled(e, U.oriented(e)), a, SIZE, weak10=0, floor=1)


def snk5_contigs(spark, sf_dir):
    """Contigs after all cleaning and concatenation to the end (SNK-5/6/11, G-12, G-14, WIN-5)."""
    return C.contig_rows(*_contigs(spark, sf_dir)).select("contig_id", "old_id", "len", "cvg", "tip", "is_palindrome", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def snk7_contig_arcs(spark, sf_dir):
    """Arcs between contigs (SNK-7)."""
    return _contigs(spark, sf_dir)[1]


QUERIES = {f.__name__: f for f in (
    snk2_edges, snk3_vertices, snk3_graph_stats, g2_single_tips, g3_minor_tips, flt5_unlinked, g5_read_paths, snk4_arcs, g7_weak_edges, g8_graph_tips, g9_graph_arcs, g10_graph_arcs, g11_graph_loops, g13_graph_short,
    g14_graph_joins, g6_bubble_pairs, g6_pinched, path2_arc_routes, snk5_contigs, snk7_contig_arcs,
)}

_READS = f"reads AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS read_id, role AS lib_id, {Q.norm('text')} AS seq FROM conversations) WHERE length(seq) >= {SIZE + 1})"
_ALLELES = f"""{_READS.replace('reads AS', 'plain AS', 1)}, reads AS (SELECT * FROM plain UNION ALL
    SELECT -read_id - 1, lib_id, left(seq, length(seq) // 2) || translate(substr(seq, length(seq) // 2 + 1, 1), 'ACTG', 'CAGT') || substr(seq, length(seq) // 2 + 2) FROM plain WHERE read_id % 3 = 0)"""
_COMP = "CASE {0} WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'T' THEN 'A' WHEN 'G' THEN 'C' END"
_TURN = "left({0}, length({0}) - 1) || CASE WHEN right({0}, 1) = '+' THEN '-' ELSE '+' END"
_KM = "left({0}, length({0}) - 1)"
#: Steps between oriented k-mers (named by spelling and sign), with the base that each appends.
_STEPS = f"""WITH RECURSIVE {_READS}, {Q.occurrences('reads', 'read_id', SIZE)}, {Q.kmers()}, {Q.neighbours(SIZE)},
    info AS MATERIALIZED (SELECT *, {Q.degree('l')} AS n_left, {Q.degree('r')} AS n_right, {Q.degree('l')} = 1 AND {Q.degree('r')} = 1 AS linear, {Q.total('l')} AS own FROM kmers),
    steps AS MATERIALIZED (SELECT km || CASE side WHEN 'r' THEN '+' ELSE '-' END AS u, nbr || CASE WHEN (nbr = word) = (side = 'r') THEN '+' ELSE '-' END AS v, w.n, substr('ACTG', CASE WHEN side = 'r' THEN base ELSE xor(base, 2) END + 1, 1) AS letter
        FROM (SELECT km, side, base, n, word, CASE WHEN {Q.num('word')} < {Q.num(Q.rc('word'))} THEN word ELSE {Q.rc('word')} END AS nbr FROM nbrs_w) w),
    linear AS MATERIALIZED (SELECT km || s AS node, own FROM info, (VALUES ('+'), ('-')) v(s) WHERE linear),
    ends AS MATERIALIZED (SELECT km || s AS node FROM info, (VALUES ('+'), ('-')) v(s) WHERE NOT linear)"""
#: Tips: walks from dead ends.
_TIPS = f"""{_STEPS},
    tip AS (SELECT u AS head, v AS cur, n, 1 AS len, [{_KM.format('u')}] AS kms, single FROM steps JOIN (SELECT km, cnt = 1 AS single FROM info WHERE n_left + n_right = 1) d ON d.km = {_KM.format('u')}
        UNION ALL SELECT head, s.v, s.n, len + 1, list_append(kms, {_KM.format('cur')}), single AND i.cnt = 1 FROM tip JOIN linear ON node = cur JOIN steps s ON s.u = cur JOIN info i ON i.km = {_KM.format('cur')} WHERE len + 1 < {2 * SIZE}),
    done AS (SELECT tip.*, i.n_left + i.n_right = 1 AS alone, CASE WHEN right(cur, 1) = '+' THEN greatest(l0, l1, l2, l3) ELSE greatest(r0, r1, r2, r3) END AS top, i.km AS end_km
        FROM tip JOIN info i ON i.km = {_KM.format('cur')} WHERE NOT i.linear)"""
_DOOMED = "doomed AS (SELECT DISTINCT unnest(CASE WHEN alone THEN list_append(kms, end_km) ELSE kms END) AS km FROM done WHERE alone OR n < top)"
#: Walks along linear nodes, edges in one direction each, and oriented edges with their nodes.
_EDGES = f"""{_STEPS},
    walk AS (SELECT u AS head, v AS first, u AS last, v AS cur, letter AS letters, 1 AS len, 0 AS cov, CAST([] AS VARCHAR[]) AS inside FROM steps JOIN ends ON node = u
        UNION ALL SELECT head, first, cur, s.v, letters || s.letter, len + 1, cov + own, list_append(inside, cur) FROM walk JOIN linear ON node = cur JOIN steps s ON s.u = cur),
    whole AS MATERIALIZED (SELECT *, CASE WHEN right(head, 1) = '+' THEN {_KM.format('head')} ELSE {Q.rc(_KM.format('head'))} END || letters AS seq FROM walk JOIN ends ON node = cur),
    kept AS (SELECT DISTINCT head AS src, first, last, cur AS dst, len, CAST(least(16000, CASE WHEN len = 1 THEN cnt * 10 ELSE cov // (len - 1) * 10 END) AS BIGINT) AS cvg10, seq, seq = {Q.rc('seq')} AS is_palindrome
        FROM whole JOIN info ON km = {_KM.format('head')} WHERE {Q.num('seq')} <= {Q.num(Q.rc('seq'))}),
    edges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY len, seq) AS edge_id, * FROM kept),
    oe AS MATERIALIZED (SELECT edge_id * 2 AS oe, src, first, dst, len, cvg10, is_palindrome FROM edges
        UNION ALL SELECT edge_id * 2 + 1, {_TURN.format('dst')}, {_TURN.format('last')}, {_TURN.format('src')}, len, cvg10, false FROM edges WHERE NOT is_palindrome)"""
_PATHS = f"""{_EDGES},
    known AS (SELECT unnest(inside) AS n, oe FROM whole w JOIN oe ON oe.src = w.head AND oe.first = w.first UNION ALL SELECT node, NULL FROM ends),
    seen AS (SELECT read_id, j, o.n, k.oe, k.n IS NOT NULL AS known FROM (SELECT read_id, j, km || CASE WHEN fwd THEN '+' ELSE '-' END AS n FROM occ) o LEFT JOIN known k USING (n)),
    part AS (SELECT *, sum(CAST(NOT known AS INTEGER)) OVER w AS part, CASE WHEN lead(known) OVER w AND lead(oe) OVER w IS NULL THEN lead(n) OVER w END AS next FROM seen WINDOW w AS (PARTITION BY read_id ORDER BY j)),
    on_edge AS (SELECT read_id, part, j, oe FROM part WHERE oe IS NOT NULL UNION ALL SELECT read_id, part, j, s.oe FROM part p JOIN oe s ON s.len = 1 AND s.src = p.n AND s.first = p.next WHERE p.known AND p.oe IS NULL),
    once AS (SELECT * FROM on_edge QUALIFY lag(oe) OVER (PARTITION BY read_id, part ORDER BY j) IS DISTINCT FROM oe),
    long_parts AS (SELECT * FROM once QUALIFY count(*) OVER (PARTITION BY read_id, part) > 1),
    paths AS MATERIALIZED (SELECT read_id, j, oe FROM (SELECT *, min(part) OVER (PARTITION BY read_id) AS one FROM long_parts) WHERE part = one)"""
_TWIN = "CASE WHEN {0}.is_palindrome THEN {0}.oe ELSE xor({0}.oe, 1) END"
_ARCS = f"""{_PATHS},
    two AS (SELECT oe AS e1, lead(oe) OVER (PARTITION BY read_id ORDER BY j) AS e2 FROM paths),
    sides AS (SELECT e1, e2, count(*) AS m FROM two WHERE e2 IS NOT NULL GROUP BY e1, e2),
    both_ways AS (SELECT * FROM sides UNION ALL SELECT {_TWIN.format('b')}, {_TWIN.format('a')}, m FROM sides JOIN oe a ON a.oe = e1 JOIN oe b ON b.oe = e2),
    arcs AS MATERIALIZED (SELECT e1, e2, CAST(sum(m) AS BIGINT) AS multiplicity FROM both_ways JOIN oe a ON a.oe = e1 JOIN oe b ON b.oe = e2 WHERE a.dst = b.src GROUP BY e1, e2)"""
#: Labels of bubbles: rounds of label correction written out, three edges a path.
_LABELS = f"""{_ARCS},
    spelled AS (SELECT oe.oe, oe.len, oe.cvg10, substr(CASE WHEN oe.oe % 2 = 0 THEN e.seq ELSE {Q.rc('e.seq')} END, {SIZE + 1}) AS own FROM oe JOIN edges e ON e.edge_id = oe.oe // 2
        WHERE NOT oe.is_palindrome AND oe.oe // 2 NOT IN (SELECT e1 // 2 FROM arcs WHERE e1 // 2 = e2 // 2)),
    step AS MATERIALIZED (SELECT e1, e2, multiplicity AS m, x.len AS len1, x.cvg10 AS cvg1, x.own AS own1, x.len / multiplicity AS took FROM arcs JOIN spelled x ON x.oe = e1 JOIN spelled y ON y.oe = e2),
    l0 AS (SELECT e1 AS s, e2 AS first, e2 AS at_, took AS time, [e2] AS path, '' AS letters, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS weight, m AS weak, true AS fresh FROM step WHERE e1 IN (SELECT e1 FROM step GROUP BY e1 HAVING count(*) > 1)),
    """ + ", ".join(f"""l{r} AS MATERIALIZED (SELECT * FROM (SELECT * REPLACE (false AS fresh) FROM l{r - 1} UNION ALL
        SELECT s, first, e2, time + took, list_append(path, e2), letters || own1, size + len1, weight + len1 * cvg1, least(weak, m), true FROM l{r - 1} JOIN step ON e1 = at_
        WHERE fresh AND size + len1 <= 100 AND e2 // 2 <> s // 2 AND NOT list_contains(list_transform(path, lambda x: x // 2), e2 // 2)) QUALIFY row_number() OVER (PARTITION BY s, first, at_ ORDER BY time, path) = 1)""" for r in (1, 2, 3))
#: Longest common subsequence of x and y: a row of its table for each letter of x, as lists of numbers.
_LCS = """list_last(list_reduce(list_prepend(list_transform(range(0, length(y) + 1), lambda i: CAST(0 AS INTEGER)), list_transform(string_split(x, ''), lambda c: [CAST(ascii(c) AS INTEGER)])),
    lambda row, c: list_reduce(list_prepend([0], list_transform(range(1, length(y) + 1), lambda j: [greatest(row[j + 1], row[j] + CAST(ascii(substr(y, j, 1)) = c[1] AS INTEGER))])), lambda done, v: list_append(done, greatest(list_last(done), v[1])))))"""
_BUBBLES = f"""{_LABELS}, met AS (SELECT *, path[1:len(path) - 1] AS inner_ FROM l3 WHERE len(path) > 1),
    top AS (SELECT *, first_value(first) OVER w AS first_, first_value(inner_) OVER w AS fast_, first_value(letters) OVER w AS y FROM met WINDOW w AS (PARTITION BY s, at_ ORDER BY time, path)),
    apart AS (SELECT *, letters AS x, greatest(length(letters), length(y)) AS longest FROM top WHERE first <> first_ AND NOT list_has_any(list_transform(inner_, lambda v: v // 2), list_transform(fast_, lambda v: v // 2))
        AND abs(length(letters) - length(y)) <= 2 AND least(length(letters), length(y)) >= {SIZE - 1}),
    scored AS (SELECT *, {_LCS} AS score FROM apart)"""
_GONE = " , ".join(f"CASE WHEN list_contains(lost, '{c}') THEN 0 ELSE {c} END AS {c}" for c in K.LINKS)

ORACLE_SQL = {
    "snk2_edges": f"{_EDGES} SELECT edge_id, CAST(len AS INTEGER) AS len, cvg10, seq, is_palindrome FROM edges",
    "snk3_vertices": f"{_STEPS} SELECT km FROM info WHERE NOT linear",
    "snk3_graph_stats": f"{_STEPS} SELECT (SELECT count(*) FROM info WHERE NOT linear) AS vertices, max(length(seq)) AS max_len, min(length(seq)) AS min_len, count(*) AS n_reads, {SIZE} AS k FROM reads",
    "g2_single_tips": f"{_TIPS} SELECT DISTINCT unnest(CASE WHEN alone THEN list_append(kms, end_km) ELSE kms END) AS km FROM done WHERE alone OR single",
    "g3_minor_tips": f"{_TIPS}, {_DOOMED} SELECT km FROM doomed",
    "flt5_unlinked": f"""{_TIPS}, {_DOOMED}, lost AS (SELECT {_KM.format('v')} AS km, list(CASE WHEN right(v, 1) = '+' THEN 'l' || strpos('ACTG', first) - 1 ELSE 'r' || strpos('ACTG', {_COMP.format('first')}) - 1 END) AS lost
        FROM (SELECT v, CASE WHEN right(u, 1) = '+' THEN left(u, 1) ELSE {_COMP.format(f'substr(u, {SIZE}, 1)')} END AS first FROM steps JOIN doomed ON km = {_KM.format('u')}) GROUP BY 1)
        SELECT km, cnt, {_GONE} FROM kmers LEFT JOIN lost USING (km) WHERE km NOT IN (SELECT km FROM doomed)""",
    "g5_read_paths": f"{_PATHS} SELECT read_id, CAST(j AS INTEGER) AS j, oe FROM paths",
    "snk4_arcs": f"{_ARCS} SELECT * FROM arcs",
    "g6_bubble_pairs": f"""{_BUBBLES.replace(_READS, _ALLELES)} SELECT s, at_ AS t, array_to_string(inner_, ',') AS slow, array_to_string(fast_, ',') AS fast, weight, size, weak FROM scored WHERE score >= longest - 2 AND 1 - score / longest <= 0.10""",
    "path2_arc_routes": f"""{_ARCS}, hops AS MATERIALIZED (SELECT e1, e2, len FROM arcs JOIN oe ON oe.oe = e2),
        walks AS (SELECT DISTINCT x.e1 AS a, y.e2 AS b, x.e1 AS at_, CAST([] AS BIGINT[]) AS route, CAST(0 AS BIGINT) AS length, 0 AS n FROM arcs x JOIN arcs y ON x.e2 = y.e1 WHERE x.e1 <> y.e2
            UNION ALL SELECT a, b, e2, CASE WHEN n = 0 THEN route ELSE list_append(route, at_) END, length + CASE WHEN n = 0 THEN 0 ELSE (SELECT max(oe.len) FROM oe WHERE oe.oe = at_) END, n + 1 FROM walks JOIN hops ON e1 = at_
            WHERE n < 4 AND length + CASE WHEN n = 0 THEN 0 ELSE (SELECT max(oe.len) FROM oe WHERE oe.oe = at_) END <= 40 AND (n = 0 OR length < 40)),
        done AS (SELECT a, b, route, length, count(*) OVER (PARTITION BY a, b) AS n_routes, row_number() OVER (PARTITION BY a, b ORDER BY route) AS nth FROM walks WHERE n > 0 AND at_ = b AND length >= 10)
        SELECT a, b, array_to_string(route, ',') AS route, length, n_routes FROM done WHERE nth <= 4""",
    "g7_weak_edges": f"{_EDGES} SELECT oe AS edge_id, CAST(len AS INTEGER) AS len, cvg10 FROM oe WHERE cvg10 > 20",
    "g8_graph_tips": f"""{_EDGES}, i AS (SELECT dst AS n, max(cvg10) AS top FROM oe GROUP BY 1), o AS (SELECT src AS n, max(cvg10) AS top FROM oe GROUP BY 1)
        SELECT oe AS edge_id, CAST(len AS INTEGER) AS len, cvg10 FROM oe e LEFT JOIN i i1 ON i1.n = e.src LEFT JOIN i i2 ON i2.n = e.dst LEFT JOIN o o1 ON o1.n = e.src LEFT JOIN o o2 ON o2.n = e.dst
        WHERE NOT (len <= {2 * SIZE} AND ((i1.n IS NULL AND cvg10 < i2.top) OR (o2.n IS NULL AND cvg10 < o1.top)))""",
    "g9_graph_arcs": f"{_ARCS} SELECT e1, e2, multiplicity FROM (SELECT *, sum(multiplicity) OVER (PARTITION BY e1) AS o, sum(multiplicity) OVER (PARTITION BY e2) AS i FROM arcs) WHERE multiplicity * 100 >= o * 30 AND multiplicity * 100 >= i * 30",
    "g10_graph_arcs": f"{_ARCS} SELECT e1, e2, multiplicity FROM (SELECT *, greatest(max(multiplicity) OVER (PARTITION BY e1), max(multiplicity) OVER (PARTITION BY e2)) AS t FROM arcs) WHERE t < 4 OR multiplicity * 100 >= t * 50",
    "g11_graph_loops": f"""{_ARCS}, named AS (SELECT e1, e2, multiplicity, least((e1, e2), ({_TWIN.format('b')}, {_TWIN.format('a')})) AS name FROM arcs JOIN oe a ON a.oe = e1 JOIN oe b ON b.oe = e2)
        SELECT e1, e2, multiplicity FROM named x WHERE e1 <> e2 AND NOT EXISTS (SELECT 1 FROM named y WHERE y.e1 = x.e2 AND y.e2 = x.e1 AND (x.multiplicity < y.multiplicity OR (x.multiplicity = y.multiplicity AND x.name > y.name)))""",
    "g13_graph_short": f"{_ARCS} SELECT oe FROM oe WHERE len <= 48 AND oe NOT IN (SELECT e1 FROM arcs UNION SELECT e2 FROM arcs)",
    "g14_graph_joins": f"""{_ARCS}, o AS (SELECT e1, min(e2) AS b FROM arcs GROUP BY e1 HAVING count(*) = 1), i AS (SELECT e2 AS b FROM arcs GROUP BY e2 HAVING count(*) = 1)
        SELECT o.e1 AS a, b FROM o JOIN i USING (b) JOIN oe x ON x.oe = o.e1 JOIN oe y ON y.oe = b WHERE o.e1 // 2 <> b // 2 AND NOT x.is_palindrome AND NOT y.is_palindrome""",
}
