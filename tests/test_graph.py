"""Small graphs with known answers."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import contigs as C
from seqloom.operators import edges as E
from seqloom.operators import gaps as G
from seqloom.operators import kmers as K
from seqloom.operators import links as L
from seqloom.operators import loci as T
from seqloom.operators import unitigs as U
from seqloom.operators.components import connected_components
from seqloom.operators.rank import numbered

SIZE = 13


def rc(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def num(x):
    return x.translate(str.maketrans("ACTG", "0123"))


def reads(spark, seqs):
    return spark.createDataFrame([(i, "a", x) for i, x in enumerate(seqs)], "read_id long, lib_id string, seq string")


def genome(n, seed=1):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def test_unitigs_spell_the_graph(spark):
    g = genome(500)
    seqs = [g[i : i + 60] for i in range(0, 440, 7)] + [g[100:160] + "ACGTTGCA" + g[300:330], g[:50] + "T"]
    after, nodes = defaultdict(set), set()
    for x in seqs:
        ws = [x[i : i + SIZE] for i in range(len(x) - SIZE + 1)]
        nodes |= {*ws, *map(rc, ws)}
        for a, b in zip(ws, ws[1:]):
            after[a].add(b)
            after[rc(b)].add(rc(a))
    linear = lambda w: len(after[w]) == 1 and len(after[rc(w)]) == 1
    want = set()
    for w in nodes:
        for v in after[w] if not linear(w) else ():
            q = w + v[-1]
            while linear(v):
                v = next(iter(after[v]))
                q += v[-1]
            want.add(min(q, rc(q), key=num))
    got = U.unitigs(K.kmer_table(reads(spark, seqs), SIZE), SIZE).toPandas()
    assert set(got.seq) == want and len(got) == len(want)


def test_circle_without_branches_gives_no_unitig(spark):
    g = genome(60, 3)
    t = K.kmer_table(reads(spark, [(g + g)[: 60 + SIZE]]), SIZE)
    linear = t.select(*[c for c in t.columns])
    assert U.unitigs(linear, SIZE).count() == 0


def test_tip_goes_and_the_path_stays(spark):
    g = genome(120, 5)
    other = {"A": "C", "C": "A", "G": "T", "T": "G"}[g[70]]
    t = K.kmer_table(reads(spark, [g] * 5 + [g[40:70] + other + g[71:75][::-1]]), SIZE)
    out = U.without_tips(t, SIZE)
    got = U.unitigs(out, SIZE).toPandas()
    assert [len(s) for s in got.seq] == [120]


def test_contigs_are_put_together_to_the_end(spark):
    g = genome(260, 11)
    # A branch that no read runs through on one side: its edges only follow the main path's.
    seqs = [g[i : i + 70] for i in range(0, 200, 10)] + [g[100:130] + genome(30, 12)]
    r = reads(spark, seqs)
    t = K.kmer_table(r, SIZE)
    edges, nodes = U.edge_table(t, SIZE)
    arcs = U.edge_arcs(U.read_paths(K.occurrences(r, SIZE), t, edges, nodes), edges)
    whole = C.spelled(edges, U.oriented(edges))
    kept = arcs.where("multiplicity > 1")  # without the branch's
    assert C.joins(arcs, whole).count() == 0 and C.joins(kept, whole).count() > 0
    e, a = C.cleaned(whole, kept, SIZE, weak10=0, percent=0, floor=1, short=0)
    assert C.joins(a, e).count() == 0
    before, after = whole.toPandas(), e.toPandas()
    assert after.len.sum() == before.len.sum() and len(after) < len(before)
    for row in after.itertuples():
        assert len(row.seq) == row.len + SIZE and (row.seq in g or rc(row.seq) in g or row.len < 60)
    assert {rc(x) for x in after.seq} == set(after.seq)
    rows = C.contig_rows(e, a).toPandas()
    assert sorted(rows.contig_id) == list(range(1, len(rows) + 1)) and rows.len.max() > 190


def test_n_windows_are_left_out(spark):
    read, place, *_ = K.windows([b"ACGTACGTACGTANACGTTTGCATGCA", b"ACG", b""], SIZE)
    assert read.tolist() == [0, 0] and place.tolist() == [0, 14]
    assert K.kmer_table(reads(spark, []), SIZE).count() == 0


@pytest.mark.parametrize("k", [12, 33])
def test_size_of_k(k):
    if k == 12:
        assert K.odd(k) == 13
    else:
        with pytest.raises(ValueError):
            K.odd(k)


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(rows, "a long, b long")).toPandas()
    assert set(got.component) == {0, 1000} and len(got) == 41 + 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    got = numbered(df, ["x"], "n").toPandas().sort_values("x")
    assert got.n.tolist() == list(range(1, 1001))


def links(spark, rows):
    return spark.createDataFrame([(a, "+", b, "+", 0, w) for a, b, w in rows], "c1 long, s1 string, c2 long, s2 string, gap long, weight int")


def contigs(spark, n):
    return spark.createDataFrame([(i, genome(100 + i, i), 77 + i) for i in range(n)], "contig_id long, seq string, len int")


def test_two_cycle_keeps_the_heavier(spark):
    got = L.without_two_cycles(links(spark, [(1, 2, 9), (2, 1, 3), (3, 4, 2)])).toPandas()
    assert sorted(zip(got.c1, got.c2, got.weight)) == [(1, 2, 9), (3, 4, 2)]


def test_kinds_and_transcripts(spark):
    fork, bubble, line = [(1, 2, 5), (2, 3, 4), (2, 4, 3)], [(5, 6, 5), (5, 7, 3), (6, 8, 5), (7, 8, 3)], [(9, 10, 4), (10, 11, 4)]
    l = links(spark, fork + bubble + line)
    of = T.loci(l)
    assert {r.locus_id: r.kind for r in T.kinds(l, of).collect()} == {1: "FORK", 5: "BUBBLE", 9: "LINEAR"}
    c = contigs(spark, 12)
    m = T.transcripts(l, of, c).toPandas().sort_values(["locus_id", "iso", "ord"])
    paths = m.groupby(["locus_id", "iso"]).contig_id.apply(list).to_dict()
    assert paths == {(1, 1): [1, 2, 3], (1, 2): [1, 2, 4], (5, 1): [5, 6, 8], (5, 2): [5, 7, 8], (9, 1): [9, 10, 11]}
    seqs = T.rendered(T.transcripts(l, of, c), c, 23).toPandas().set_index(["locus_id", "iso"]).seq
    assert seqs[9, 1] == genome(109, 9) + genome(110, 10)[23:] + genome(111, 11)[23:]


def test_loops_are_cut(spark):
    l = links(spark, [(1, 2, 5), (2, 3, 4), (3, 1, 1)])
    got = T.without_loops(l, T.loci(l)).toPandas()
    assert sorted(zip(got.c1, got.c2)) == [(1, 2), (2, 3)]


def test_transitive_link(spark):
    rows = [(1, "+", 2, "+", 10, 5), (2, "+", 3, "+", 10, 5), (1, "+", 3, "+", 100, 4)]
    l = spark.createDataFrame(rows, "c1 long, s1 string, c2 long, s2 string, gap long, weight int")
    got = L.transitive(l, contigs(spark, 5)).collect()
    assert [(r.c1, r.c2) for r in got] == [(1, 3)]


def test_bubble_alignment(spark):
    a, b = "ACTGACTGACTGACTGACTGAA", "ACTGACTGACTAACTGACTGAA"
    df = spark.createDataFrame([(1, 0, 9, 22, 100, a), (2, 0, 9, 22, 30, b), (3, 0, 9, 22, 10, "T" * 22), (4, 1, 9, 22, 10, a)], "edge_id long, src long, dst long, len long, cvg10 long, seq string")
    assert [(r.slow, r.fast) for r in E.bubbles(df, "seq", 13).collect()] == [(2, 1)]
    got = df.limit(1).select(S.lcs_score(F.lit("ACTG"), F.lit("AXTG")).alias("s"), S.lcs_trace(F.lit("ACTG"), F.lit("ATG")).alias("t")).first()
    assert got.s == 3 and list(got.t) == [0, -1, 1, 2]


def test_gap_fill():
    g = genome(300, 8)
    assert G.fill(g[:100], g[160:], [g[i : i + 80] for i in range(60, 200, 10)], 60, 23) == g[100:160]
    assert G.fill(g[:100], g[160:], [], 60, 23) is None


def test_scalar_functions(spark):
    row = spark.createDataFrame([("acgN.x-1Z",)], "t string").select(S.normalize(F.col("t")).alias("n")).first()
    assert row.n == "ACGGAAC"
    r = spark.createDataFrame([("ACTGG",)], "s string").select(S.revcomp(F.col("s")).alias("r"), S.unpack(S.pack(F.col("s")), 5).alias("u"), S.next_kmer(F.col("s"), F.lit("A")).alias("n"), S.prev_kmer(F.col("s"), F.lit("A")).alias("p")).first()
    assert (r.r, r.u, r.n, r.p) == ("CCAGT", "ACTGG", "CTGGA", "AACTG")
