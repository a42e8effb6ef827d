"""Helpers shared by the operators: tables, shared scratch space, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: dict = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """``make()``, kept between the tasks of a Python worker until another name is asked for.

    A worker serves stage after stage; it holds the model and memo of one operator only.
    """
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        _KEPT[name] = make()
    return _KEPT[name]


#: Words are runs of bytes other than ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: set it to a folder that driver and executors share")
    if not base:  # a single machine, as in tests
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts lineage, survives lost executors.

    ``file_rows`` bounds the rows of a file, for large rows: a task that reads Parquet holds up to 4,096 rows of a file at once.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans whose results are stored: it does when the driver collects its garbage, else every half hour."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Give the memory that Python has freed back to the system: the driver keeps it after a training else, a worker after its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not in every C library
        release(0)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null and blank texts have none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller Arrow batches, so that long texts don't pile up in one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller Arrow batches, of so many rows and bytes of a text column (or of one longer text)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def map_text(df: DataFrame, key: list[str], text: str, schema: str, make: Callable[[], Callable], kind: str = "str") -> DataFrame:
    """Apply ``make()`` to the texts of each Arrow batch; null texts count as empty.

    ``make()`` runs once a task and returns a function from texts to one
    Arrow array (or list) for each new column of ``schema``, in order. It gets the texts as
    a list of ``str`` or of UTF-8 ``bytes``, or as an ``arrow`` array, by ``kind``.
    """
    spark = df.sparkSession
    kept = [F.col(f"`{c}`") for c in key]
    out = df.select(*kept, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    full = spark.createDataFrame([], schema).schema
    fields_before = out.schema.fields[:-1]
    fields = [*fields_before, *full.fields]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in sized(batches, len(fields_before)) if kind == "arrow" else slices(batches):
            new = f(_texts(b.column(len(fields_before)), kind))
            columns = [*b.columns[:-1], *new]
            yield pa.RecordBatch.from_arrays(
                [c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, arrow)],
                schema=arrow,
            )
        trim()

    return out.mapInArrow(run, StructType(fields))


def _texts(column: pa.Array, kind: str):
    if kind == "arrow":
        return column
    return (column.cast(pa.binary()) if kind == "bytes" else column).to_pylist()


def filter_text(df: DataFrame, text: str, make: Callable[[], Callable[[pa.StringArray], np.ndarray]]) -> DataFrame:
    """The rows whose texts ``make()`` (once a task) keeps; null texts count as empty. All columns pass through."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for b in sized(batches, at):
            yield b.filter(pa.array(keep(pc.fill_null(b.column(at), "")), pa.bool_()))
        trim()

    return df.mapInArrow(run, df.schema)
