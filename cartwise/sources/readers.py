"""Scans. Fixed-schema CSV for the clickstream files, schema-on-read for
"any table". Every reader is lazy: nothing runs until an action."""

from __future__ import annotations

import os
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from cartwise.sources.schemas import CATEGORY_SCHEMA, EVENTS_SCHEMA, PROPS_SCHEMA


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event log CSV (header, epoch-ms ``timestamp``)."""
    return spark.read.csv(path, header=True, schema=EVENTS_SCHEMA)


def read_item_properties(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Item-property history, any number of part files, unioned by name."""
    if isinstance(paths, str):
        paths = [paths]
    parts = [spark.read.csv(p, header=True, schema=PROPS_SCHEMA) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category tree as parent pointers (loaded only; nothing walks it)."""
    return spark.read.csv(path, header=True, schema=CATEGORY_SCHEMA)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, local or remote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def table_format(spark: SparkSession, path: str) -> str:
    """The format that a path stands for: its suffix decides, and a folder
    without one is Parquet; anything else is CSV."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".csv", ".parquet"):
        return suffix[1:]
    return "parquet" if _is_folder(spark, path) else "csv"


def read_any(spark: SparkSession, path: str, schema=None, fmt: str | None = None) -> DataFrame:
    """Any Parquet or CSV (with header) table. Without a ``schema`` CSV types
    are inferred, which reads the file once more. Errors are the reader's."""
    path = (path or "").strip()
    if not path:
        raise ValueError("no path given")
    fmt = fmt or table_format(spark, path)
    options = {} if fmt == "parquet" else {"header": True} if schema else {"header": True, "inferSchema": True}
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def validate(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether Spark can resolve the table at ``path``, and what it found or
    why it could not."""
    try:
        columns = read_any(spark, path).columns
    except (ValueError, PySparkException, Py4JJavaError) as e:
        return False, f"cannot be read: {str(e).splitlines()[0]}"
    return True, f"{len(columns)} columns: {', '.join(columns)}"
