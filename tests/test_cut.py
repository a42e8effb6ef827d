"""Tables between rounds: joins know their size, and past rounds leave nothing."""

from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.operators.components import cut, recut


def test_rows_that_tasks_make_are_not_taken_for_few(spark):
    def many(batches):
        for b in batches:
            for n in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(range(n * 400_000, (n + 1) * 400_000), pa.int64())], ["km"])

    table = cut(spark.range(4).mapInArrow(many, "km long"))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > 1_000_000  # a checkpoint keeps the estimate of four rows, and all is broadcast
    assert table.agg(F.count("*"), F.sum("km")).first()[:] == (1_600_000, 1_600_000 * 1_599_999 // 2)


def test_the_round_before_goes(spark):
    first = cut(spark.range(10).toDF("a"))
    second = recut(first.where("a > 3"), first)
    assert second.count() == 6
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert not (folder / first._cut_path.rsplit("/", 1)[1]).exists() and (folder / second._cut_path.rsplit("/", 1)[1]).exists()
