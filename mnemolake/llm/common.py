"""What the operators of this subpackage share: tables, cut lineage, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts may be long, so a batch must stay small.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at a time; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master where none is configured (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _LOCAL.get(spark.sparkContext.applicationId)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="mnemolake-")
    return f"{base.rstrip('/')}/mnemolake"


_LOCAL: dict[str, str] = {}
#: Tables that materialize() has written, in order.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage through a Parquet table in the shared folder: a lost executor loses nothing of it."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    del df
    # lets Spark remove the shuffle files of steps that nothing names any more; local runs do without the wait
    for _ in range(0 if spark.sparkContext.master.startswith("local[") else 2):
        gc.collect()
        time.sleep(0.2)  # Python's side tells the JVM what it dropped a little later
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for df in tables:
        delete_table(df.sparkSession, df._table_path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators write for themselves meanwhile; results are to be written before the end."""
    mark = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[mark:]:
            delete_table(spark, path)
        del _WRITTEN[mark:]


def delete_table(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Two columns, id and text, whatever else the table carries; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function on one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that isn't used any more to the system: Spark keeps its Python workers, and what each holds adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def string_buffers(column: pa.Array):
    """Offsets and bytes of a string column without copies, as numpy arrays."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def texts(column: pa.Array) -> list[bytes]:
    at, data = string_buffers(column)
    whole, at = memoryview(data), at.tolist()
    return [bytes(whole[a:b]) for a, b in zip(at, at[1:])]
