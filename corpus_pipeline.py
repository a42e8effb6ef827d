"""A training-data pipeline over ``documents``: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import quality, toxicity
from seqloom.llm.bpe import byte_bpe
from seqloom.llm.common import stored, table
from seqloom.llm.decontaminate import decontaminated
from seqloom.llm.neardedup import deduplicated
from seqloom.llm.queries import quality_model, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score as toxic go."""
    return toxicity.accepted(docs, toxicity_model(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score as of low quality go."""
    return quality.accepted(docs, quality_model(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each near-duplicate group stays."""
    return deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the kept documents' token ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe(docs, path, public_tokenizers.PATTERN, key=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: The trained and hashed stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
