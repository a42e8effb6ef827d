"""The training-data operators against brute force, libraries and round trips."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from seqloom.llm import bpe, decontaminate, fst, idfiles, labels, neardedup, ppm, quality, shards, simhash, toxicity, vectors

ODD = ["", "  ", None, " a  b \n c", "a" * 700, "the" * 300, "it's  I'LL don't ", "x\x1cy z", "日本語" * 40, "é" * 70 + " ab", "<|endoftext|> a", "foo<|endoftext|>bar's", "ΑΣ İs ẞ", "!!! ...\r\n\r\n z", "1234 12a3 ½ x²"]


def docs(spark, texts, first=0):
    """Documents with an extra column of a clashing name."""
    return spark.createDataFrame([(i + first, t, "a", f"s{i % 2}", len(t or ""), 1.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score double")


def empty(spark):
    return docs(spark, ["x"]).limit(0)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r.doc_id: r.text for r in corpus.select("doc_id", "text").collect()}


def test_byte_bpe_is_the_librarys(spark, texts):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    cases = ODD + list(texts.values())[:40]
    got = bpe.byte_bpe(docs(spark, cases), path, P.PATTERN, ["doc_id"], decoded="back").collect()
    for r in got:
        t = cases[r.doc_id] or ""
        assert list(r.ids) == lib.encode_ordinary(t) and bytes(r.back) == t.encode()
    assert bpe.byte_bpe(empty(spark), path, P.PATTERN, ["doc_id"]).count() == 0


def test_lockstep_and_single_merges_agree():
    b = bpe.ByteBpe(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    pieces = [b"hello", b"abababab", b"aaaaaaa", "größer".encode(), b"zq"]
    ids, n = bpe.merge_many(pieces, b.first, b.pairs)
    assert ids.tolist() == [i for p in pieces for i in bpe.merge_one(p, b.first.tolist(), b.pairs.one)]


def test_token_counts_are_the_librarys(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    cases = ODD + list(texts.values())[:40]
    got = fst.token_counts(docs(spark, cases), path, ["doc_id"]).collect()
    for r in got:
        t = cases[r.doc_id] or ""
        assert r.n_tokens == len(lib.encode(t, add_special_tokens=False).ids) and r.n_bytes == len(t.encode())
    assert fst.token_counts(empty(spark), path, ["doc_id"]).count() == 0


def test_id_files_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    cases = ODD + list(texts.values())[:40]
    got = idfiles.packed_ids(docs(spark, cases, 5).repartition(3), path, 2).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(got, cases):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert idfiles.packed_ids(empty(spark), path, 2).count() == 0


class _Bytes:
    def __init__(self, b):
        self.b = b

    def size(self):
        return len(self.b.getvalue())

    def seek(self, at):
        self.b.seek(at)

    def read(self, n):
        return self.b.read(n)


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17])
def test_any_range_of_ids_is_read(bits):
    r = np.random.default_rng(bits)
    rows = [r.integers(0, 1 << bits, n).tolist() for n in (0, 3, 9000, 1, 8192)]
    ids = [x for row in rows for x in row]
    f = idfiles.Reader(_Bytes(idfiles.in_memory(rows, bits)))
    assert f.ids(0, f.total).tolist() == ids and f.ids(8000, 9500).tolist() == ids[8000:9500] and f.counts.tolist() == [len(x) for x in rows]


def test_shards_are_near_equal_and_whole(spark, texts):
    cases = [None, "", "same", "same"] + [t for t in texts.values()] + ["copy " * 50] * 300
    got = shards.pack_shards(docs(spark, cases), 8).toPandas()
    assert sorted(got.doc_id) == list(range(len(cases)))
    size = got.groupby("shard")["size"].sum()
    size = sorted(size)[:-1]  # the 300 copies are over the fair share, alone in theirs
    assert len(size) == 7 and max(size) - min(size) <= 0.01 * min(size)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    at = got.set_index("doc_id").shard
    assert at[2] == at[3] and at[0] == at[1] and got[got.doc_id >= len(cases) - 300].shard.nunique() == 1
    assert shards.pack_shards(empty(spark), 8).count() == 0


def test_a_group_over_the_fair_share_is_alone():
    sizes = np.array([1000, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    out = shards.pack(sizes, 3)
    assert (out == out[0]).sum() == 1 and set(out) == {0, 1, 2}
    load = np.bincount(out, sizes)[1:]
    assert abs(load[0] - load[1]) <= 1


def test_language_model_is_brute_forces(spark, texts):
    cases = [None, "", "A a  b", "A a  b"] + list(texts.values())[:60]
    from pyspark.sql import functions as F

    held = F.col("doc_id") % 4 == 1
    got = {r.doc_id: r for r in ppm.score_texts(docs(spark, cases), ~held).collect()}
    bags = [ppm.tokens((t or "").encode()) for t in cases]
    order = ppm.ORDER
    words, nodes = Counter(), {}
    for i, b in enumerate(bags):
        if i % 4 != 1:
            words.update(b + [ppm.END_TOKEN])
            s = ppm.stream(b, order)
            for j in range(order, len(s)):
                nodes.setdefault(s[j - order : j], Counter())[s[j]] += 1
    for k in range(order, 0, -1):  # shorter contexts count the longer ones that a symbol was seen in
        for context, after in [x for x in nodes.items() if len(x[0]) == k]:
            nodes.setdefault(context[1:], Counter()).update(after.keys())
    total, kinds = sum(words.values()), len(words)

    def log(path):
        gone, out = set(), 0.0
        for k in range(order + 1):
            live = {s: n for s, n in nodes.get(path[k:-1], {}).items() if s not in gone}
            if live:
                whole = 2 * sum(live.values())
                if path[-1] in live:
                    return out + np.log10((2 * live[path[-1]] - 1) / whole)
                out += np.log10(len(live) / whole)
                gone |= set(live)
        return out - np.log10(ppm.SYMBOLS - len(gone))

    for i, b in enumerate(bags):
        s, r = ppm.stream(b, order), got[i]
        tokens = b + [ppm.END_TOKEN]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in words for w in tokens), total)
        assert r.base_score == pytest.approx(sum(np.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens))
        assert r.score == pytest.approx(sum(log(s[j - order : j + 1]) for j in range(order, len(s))), abs=1e-3)
    assert ppm.score_texts(empty(spark), F.lit(True)).count() == 0


def test_scores_do_not_depend_on_the_size_of_the_trie(spark, texts):
    from pyspark.sql import functions as F

    d, train = docs(spark, [None, "", "A a  b", "never seen: zq \u65e5"] + list(texts.values())[:40]), F.col("doc_id") % 4 != 3
    want = {r.doc_id: r.score for r in ppm.score_texts(d, train).collect()}
    got = {r.doc_id: r.score for r in ppm.score_texts(d, train, most=500).collect()}
    assert got == pytest.approx(want, abs=1e-2, rel=1e-6) and len(got) == 44


def test_classifiers_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    from pyspark.sql import functions as F

    known, d = spark.read.parquet(f"{big}/labels.parquet"), spark.read.parquet(f"{big}/documents.parquet")
    held = labels.remainder("doc_id", 5) == 0
    judged = d.join(known, "doc_id").where(held).select("doc_id", "text", "quality", "toxic")
    q = quality.score(judged, quality.train(labels.sample(d, known, "quality", ~held)), ["doc_id", "quality"]).toPandas()
    assert ((q.score >= 0.5) == (q.quality == 1)).mean() > 0.98
    t = toxicity.score(judged, toxicity.train(labels.sample(d, known, "toxic", ~held)), ["doc_id", "toxic"]).toPandas()
    assert ((t.score >= 0.5) == (t.toxic == 1)).mean() > 0.96
    odd = docs(spark, ODD)
    for module, model in ((quality, quality.train([])), (toxicity, toxicity.train([]))):
        assert module.score(odd, model, ["doc_id"]).where(F.col("score").isNull()).count() == 0
        assert module.score(empty(spark), model, ["doc_id"]).count() == 0


def _fingerprint(text, width):
    import xxhash

    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, texts):
    cases = ODD + list(texts.values()) + [next(iter(texts.values())) + " more"] * 2
    got = simhash.near_duplicates(docs(spark, cases)).toPandas().sort_values("doc_id")
    fps = [_fingerprint(t, 3) for t in cases]
    assert [f & (1 << 64) - 1 for f in got.fp.tolist()] == fps
    part = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    assert got.component_id.tolist() == part
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_near_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    x = np.concatenate([base + r.normal(size=base.shape) * s for s in (0, 0.05, 0.15, 0)])
    rows = [(i, [float(v) for v in row], int(i % 3)) for i, row in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [1.0] * 16, None), (905, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df, 0.93).toPandas().set_index("vec_id")
    n = x / np.linalg.norm(x, axis=1)[:, None]
    lab = np.arange(len(x)) % 3
    near = (n @ n.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    found = got.n_links.reindex(range(len(x))).to_numpy()
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert (got.n_links.loc[900:] == 0).all() and (got.component_id.loc[900:] == got.index[got.index >= 900]).all()
    assert vectors.near_vectors(df.limit(0), 0.93).count() == 0


def test_vectors_of_repeated_and_missing_ids(spark):
    r = np.random.default_rng(4)
    a, b, c, d = (r.normal(size=8) for _ in range(4))
    near = lambda v, s=0.01: v + r.normal(size=8) * s
    rows = [(5, a, 1), (5, b, 1), (7, near(a), 1), (9, near(b), 1), (None, c, 1), (None, near(c), 1), (8, near(c), 1), (8, near(c), 1), (8, c, 2), (None, d, 1), (None, d, 1), (3, near(b), 1), (11, near(a), None), (2, None, 1)]
    rows = [(i, None if v is None else [float(x) for x in v], l, 3) for i, v, l in rows]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int"), 0.93).collect()
    part, links = list(range(len(rows))), [0] * len(rows)
    for i, (_, x, l, _) in enumerate(rows):
        for j, (_, y, m, _) in enumerate(rows):
            if i != j and x and y and l is not None and l == m and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    want = []
    for i, (key, *_) in enumerate(rows):
        name = min((rows[k][0] for k in range(len(rows)) if part[k] == part[i] and rows[k][0] is not None), default=None)
        want.append((key, links[i], name, key is not None and name == key))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and sum(links) > 20


def test_decontamination(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(1, " ".join(words[:30])), (2, " ".join(words[100:160])), (3, "Only Three here"), (4, None), (5, " "), (6, "one two three four five")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cases = [
        "x y " + " ".join(words[:30]).upper() + " z", " ".join(words[90:130] + ["new"] + words[131:170]), " ".join(words[:12]), "say only three HERE now", None, "", "one two three four five",
        " ".join(words[200:300]), "a b " + " ".join(words[1:30]), "x y " + " ".join(words[:30]) + " q " + " ".join(words[:30]),
    ]
    got = decontaminate.leaks(docs(spark, cases), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, 2), (3, 3), (6, 6), (8, 1), (9, 1)}
    assert {r.doc_id: r.start for r in got if r.similarity == 1.0} == {0: 2, 3: 1, 6: 0, 9: 2}
    kept = decontaminate.decontaminated(docs(spark, cases), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7] and kept.columns == docs(spark, cases).columns
    assert decontaminate.leaks(empty(spark), bench).count() == 0 and decontaminate.leaks(docs(spark, cases), bench.limit(0)).count() == 0


def test_documents_shorter_than_the_item_leak_it(spark):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b c d e f g h i j k l m n")], "item_id long, text string")
    cases = [" ".join(words[:n]) for n in range(44, 60)] + [" ".join(words[:20] + ["new"] + words[21:55]), "a b c d e f g h i j k l", "b c d e f g h i j k l"]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, cases), bench).collect()}
    want = {(i, 1): (n - 4) / 56 for i, n in enumerate(range(44, 60)) if n - 4 >= 0.8 * 56} | {(17, 2): 0.8}
    assert {k: r.similarity for k, r in got.items()} == pytest.approx(want) and {r.start for r in got.values()} == {0}


def test_near_copies_go(spark, texts):
    long = [t for t in texts.values() if t and 300 < len(t.split()) < 900][:10]
    edited = [re.sub(r"^(\S+ )(.*)$", r"\1changed \2", t, flags=re.S) for t in long]
    cases = long + edited + long + [None, "", "   "]
    kept = neardedup.deduplicated(docs(spark, cases))
    got = sorted(r.doc_id for r in kept.collect())
    assert got[:10] == list(range(10)) and len(got) == 12 and got[10:] == [30, 32]
    assert neardedup.deduplicated(empty(spark)).count() == 0


def test_odd_ids_of_near_copies(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (5, a + " more"), (None, a), (None, b + " more"), (None, "alone " + b[:40]), (None, "alone " + b[:40]), (7, None), (3, "")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, own string, mark int")
    got = neardedup.deduplicated(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "alone " + b[:40]), (3, ""), (5, a), (5, b)]


def test_rows_without_an_id_are_decontaminated(spark):
    leak, clean = " ".join(f"w{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    d = spark.createDataFrame([(1, leak, 0), (1, clean, 0), (None, leak, 0), (2, clean, 0)], "doc_id long, text string, rid int")
    kept = decontaminate.decontaminated(d, bench)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, clean), (2, clean)] and kept.columns == d.columns
    assert sorted((r.doc_id or 0, r.item_id, r.similarity) for r in decontaminate.leaks(d, bench).collect()) == [(0, 1, 1.0), (1, 1, 1.0)]


def test_id_files_keep_rows_without_an_id(spark):
    d = spark.createDataFrame([(1, "a b"), (None, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = idfiles.packed_ids(d, P.path("word_bpe_49k.json"), 2).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1), (None, 1, 2), (1, 3, 2), (1, 5, 3)]


def _near(cases, least=neardedup.LEAST):
    """Component of each text by comparing all pairs."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in cases]
    part = list(range(len(cases)))
    for j in range(len(cases)):
        for i in range(j):
            if part[i] != part[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    return part


def _grouped(spark, cases):
    return [r.component for r in neardedup.groups(docs(spark, cases)).orderBy("id").collect()]


def test_near_copies_with_one_contiguous_change_or_few_words_go(spark):
    rng, cases = np.random.default_rng(1), []
    for n in (9, 13, 20, 30, 100, 300, 500):
        for _ in range(8):
            w = [f"w{i}" for i in rng.integers(0, 10**6, n)]
            footer = [f"w{i}" for i in rng.integers(0, 10**6, n // 5)]
            cases += [" ".join(x) for x in (w, w + footer, footer + w, w[:-1] + ["last"], w[:-2])]
    want = _near(cases)
    assert sum(p != i for i, p in enumerate(want)) > 150 and _grouped(spark, cases) == want


def test_near_copies_in_a_family_of_other_texts_go(spark):
    rng, shared = np.random.default_rng(2), "a form that all of a family fill in with words of their own".split()
    cases = []
    for _ in range(60):  # alike in words, so that they meet in the views, but not near
        cases.append(" ".join(w for i in rng.permutation(60) for w in (shared[i % 13], shared[i % 7])))
    cases += [" ".join(t.split()[:-3] + ["end"]) for t in cases]
    want = _near(cases)
    assert sorted(set(want)) == list(range(60)) and _grouped(spark, cases) == want


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "byte_bpe"]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = C.run(spark, sf_dir)
    n = out.count()
    assert 0 < n < d.count() and out.select("doc_id").distinct().count() == n


def test_digests_of_the_query(spark, sf_dir, texts):
    from seqloom.llm.queries import QUERIES

    got = QUERIES["op1_byte_bpe"](spark, sf_dir).toPandas().set_index("doc_id")
    assert all(got.decoded_sha256[i] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items())
