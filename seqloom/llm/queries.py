"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import labels, quality, toxicity
from seqloom.llm.bpe import byte_bpe
from seqloom.llm.common import table, trim
from seqloom.llm.decontaminate import leaks
from seqloom.llm.filter_audit import filter_audit
from seqloom.llm.fst import token_counts
from seqloom.llm.idfiles import packed_ids
from seqloom.llm.ppm import score_texts
from seqloom.llm.prefix_trie import prefix_trie
from seqloom.llm.secret_scan import joined, secret_spans
from seqloom.llm.shards import pack_shards
from seqloom.llm.simhash import near_duplicates
from seqloom.llm.vectors import near_vectors

#: The end id that the id files put after each document.
END_ID = 2
#: More tokens than this are over the context limit.
TOKEN_LIMIT = 2048
SHARDS = 40
COSINE = 0.93


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; counts and digests of both."""
    coded = byte_bpe(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        key=["doc_id"],
        decoded="decoded",
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak: one row a document and item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all documents into shards of near equal bytes, equal texts together."""
    put = pack_shards(table(spark, sf_dir, "documents"), SHARDS)
    return put.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to bit-packed files and read them back."""
    return packed_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def _judged(scored: DataFrame, fold: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        (labels.remainder("doc_id", fold) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def quality_model(spark: SparkSession, sf_dir: str) -> tuple:
    """Trained on rows whose crc32(doc_id) mod 3 is not 1."""
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(labels.sample(docs, known, "quality", labels.remainder("doc_id", 3) != 1))
    trim()
    return model


def toxicity_model(spark: SparkSession, sf_dir: str) -> tuple:
    """Trained on rows whose crc32(doc_id) mod 5 is not 0."""
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(labels.sample(docs, known, "toxic", labels.remainder("doc_id", 5) != 0))
    trim()
    return model


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for quality."""
    return _judged(quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), ["doc_id"]), 3, 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity."""
    return _judged(toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir), ["doc_id"]), 5, 0)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a model of the rows whose crc32(doc_id) mod 5 is not 1."""
    held = labels.remainder("doc_id", 5) == 1
    scored = score_texts(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by fingerprints of 3-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings of a label."""
    return near_vectors(table(spark, sf_dir, "embeddings"), COSINE)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and which are over the limit."""
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), key=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the fixed patterns' spans, and random strings by their tokens."""
    found = secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "random")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations' prefixes."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters take from each other, over all documents and orders."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_pack_shards": op3_pack_shards,
    "op4_packed_ids": op4_packed_ids,
    "op5_ppm": op5_ppm,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_vectors": op9_vectors,
    "op10_toxicity": op10_toxicity,
    "op11_secrets": op11_secrets,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

#: crc32 of the decimal id, bit by bit: the reflected polynomial, all ones before and after.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""

_TRIE = f"""WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, {_CRC.format('c')} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
    turns AS (SELECT k.c, nth, 0 AS own, role, text FROM convs k JOIN own o ON o.c = k.c - k.c % 20 AND nth <= h UNION ALL SELECT k.c, nth, 1, role, text FROM convs k JOIN own o USING (c) WHERE nth > h),
    placed AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, nth) AS pos FROM turns),
    ids AS (SELECT role, text, row_number() OVER () AS id FROM (SELECT DISTINCT role, text FROM turns)),
    seqs AS (SELECT k.c, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []) AS seq FROM convs k LEFT JOIN (SELECT c, pos, id FROM placed JOIN ids USING (role, text)) USING (c) GROUP BY k.c),
    rows AS (SELECT c, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS depth, seq FROM seqs),
    pre AS (SELECT c, size, depth, seq[1:depth] AS p FROM rows),
    nodes AS (SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = depth), '') AS ends FROM pre GROUP BY p, depth),
    own_saved AS (SELECT n.*, (n_convs - 1) * coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0) AS saved, NOT EXISTS (SELECT 1 FROM nodes k WHERE k.depth = n.depth + 1 AND k.p[1:n.depth] = n.p) AS leaf
        FROM nodes n LEFT JOIN ids ON id = n.p[-1]),
    sub AS (SELECT u.p[1:d] AS p, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (u.depth = d + 1) AS n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own_saved) u GROUP BY 1)
    SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN sub USING (p) LEFT JOIN nodes m ON m.depth = n.depth - 1 AND m.p = n.p[1:n.depth - 1]"""

_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM d LEFT JOIN marks USING (doc_id)),
    counts AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, f),
    letters AS (SELECT unnest(range(1, 6)) AS i),
    orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    steps AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step, o[step] AS i, o[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    cases AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, i, n, good, toxic, f[i] AS hit, len(list_filter(before, lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda x: x)) = 1 AS single FROM counts, steps),
    sums AS (SELECT part, filter_order, step, i, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (hit AND single), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM cases GROUP BY ALL)
    SELECT * EXCLUDE (i), CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM sums"""

#: SQL for DuckDB, where it can express the operator.
ORACLE_SQL: dict[str, str] = {"op12_prefix_trie": _TRIE, "op13_filter_audit": _AUDIT}
