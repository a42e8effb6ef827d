"""Tables of large rows."""

from pyspark.sql import functions as F


def test_files_of_large_rows_hold_few(spark):
    from seqloom.llm import filter_audit as A

    docs = spark.range(6 * A.SHARD_ROWS).coalesce(1).selectExpr("id as doc_id", "'a b' as text", "'x' as source")
    shards = A._coded(docs, "doc_id", "text", "source")[0]
    files = shards.select(F.input_file_name().alias("f"), "shard").groupBy("f").count().collect()
    assert sum(f["count"] for f in files) >= 6 and max(f["count"] for f in files) <= A.FILE_SHARDS
