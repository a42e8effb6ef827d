"""A bounded, reproducible sample of labelled texts, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: At most so many documents of each class, and so many bytes of text in all, train a classifier.
MAX_DOCS = 1_000
MAX_BYTES = 8 << 20


def remainder(key: str, by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def sample(
    docs: DataFrame, labels: DataFrame, label: str, train, key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES
) -> list[tuple[str, int]]:
    """(text, label) of labelled rows for which the Column ``train`` holds.

    Of each class, the ``max_docs`` rows of least hashed id are taken, while their texts
    stay within half of ``max_bytes``: those of over a hundredth of that come last, and the first
    row is always taken. Texts are whole. Ids labelled twice count once,
    with the greater label. Rows without a label, id or text are left out.
    """
    marked = labels.where(F.col(label).isNotNull() & train).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))
    best = marked.select("id", "label", F.xxhash64("id").alias("at"))
    picked = [best.where(F.col("label") == c).orderBy("at", "id").limit(max_docs) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_docs rows at most
    sizes = (
        docs.select(F.col(key).alias("id"), F.octet_length(F.col(text)).alias("n"))
        .where("n is not null")
        .join(ids, "id")
        .groupBy("id", "label", "at")
        .agg(F.max("n").alias("n"))
    )
    order = Window.partitionBy("label").orderBy(F.col("n") > max_bytes // 200, "at", "id")
    sizes = sizes.withColumn("upto", F.sum("n").over(order)).withColumn("nth", F.row_number().over(order))
    fits = sizes.where((F.col("upto") <= max_bytes // 2) | (F.col("nth") == 1)).select("id", "label", "at", "n")
    rows = (
        docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(fits), "id")
        .where(F.octet_length("text") == F.col("n"))
        .groupBy("id", "label", "at")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.at, r.id))]
