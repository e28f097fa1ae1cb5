"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import scratch


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    return scratch(spark, name)


#: Bytes of an Arrow batch between Spark and Python while intermediate tables are made: both sides hold several times that.
ARROW_BYTES = 16 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives the loss of any executor.
    """
    spark = df.sparkSession
    path, before = work_path(spark, name), spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(ARROW_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, before)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done.

    It does so when the driver collects its garbage, which a driver that only
    plans seldom does of its own accord.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class _Holder:
    """Whose caches a worker process holds now."""

    owner: str | None = None
    clear: Callable[[], None] | None = None


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Let a worker process keep the caches of one operator only.

    Workers are reused, so that an operator's caches outlive its tasks; the
    first task of another operator drops them and gives the memory back.
    """
    if _Holder.owner == owner:
        return
    before, _Holder.owner, _Holder.clear = _Holder.clear, owner, clear
    if before is not None:
        before()
        release_memory()


def release_memory() -> None:
    """Give unused memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most about ``most_bytes``.

    A slice holds one row at least, so a very long text is a slice of its own.
    """
    for b in batches:
        rows = b.num_rows
        step = max(1, rows * most_bytes // max(b.nbytes, 1)) if rows else 1
        for at in range(0, rows, step):
            yield b.slice(at, step)


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string; to be called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def digests(data: bytes, size: int = 16) -> pa.Array:
    """A binary column of values of ``size`` bytes each, without a Python object for each."""
    n = len(data) // size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(data)])


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Run a Python row function over Arrow batches of the named columns.

    ``make()`` runs once per task and returns ``row(*values) -> tuple``, one
    output row for each input row.  Only the named columns leave the JVM.
    """
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for b in batches_of(batches):
            yield record_batch([row(*values) for values in zip(*(c.to_pylist() for c in b.columns), strict=True)], fields)

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)
