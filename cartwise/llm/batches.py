"""Small helpers for operators that run Python inside Spark's Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of input that a batch function sees at once.
SLICE_BYTES = 4 << 20


def ship_library(spark: SparkSession) -> None:
    """Workers that may not have been started with this library on their path
    (a local session started elsewhere) get it. On a cluster the package is
    shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (paths, root) if p)


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` with this library on the workers' path."""
    ship_library(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes (a row at least), so that
    results leave the worker in small pieces however long the texts are."""
    rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_HELD: dict = {}


def worker_state(key, make: Callable):
    """``make()``, kept for the further tasks of this worker process. A worker
    holds the state of one operator at a time: another key lets go of it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """The column's strings one at a time (null: empty), so that only the
    Arrow batch and one Python string are in memory."""
    for value in column:
        yield value.as_py() or ""


def add_columns(df: DataFrame, fields: list[T.StructField],
                make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """``df`` with ``fields`` appended, computed per Arrow batch.

    ``make()`` runs once per task and returns the batch function. Input
    columns of the same names are replaced, so clashing extra columns can't
    shadow the result. Column order: the input's, then the new ones.
    """
    names = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in names]
    out_schema = T.StructType(keep + fields)
    arrow = to_arrow_schema(out_schema)
    keep_at = [i for i, f in enumerate(df.schema.fields) if f.name not in names]

    def run(batches):
        fn = make()
        for batch in batches:
            for b in slices(batch):
                cols = [b.column(i) for i in keep_at] + fn(b)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c
                     for i, c in enumerate(cols)], names=arrow.names)
        pa.default_memory_pool().release_unused()

    return map_batches(df, run, out_schema)
