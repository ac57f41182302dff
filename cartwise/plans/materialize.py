"""Cutting lineage for frames that several consumers reuse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartwise.config import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for ``name`` under this application's tables in the shared
    checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/tables/{name}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a Parquet table under the session's shared
    checkpoint folder (``spark.checkpoint.dir``) and read it back.

    Later consumers scan the table - with column pruning and filter pushdown,
    which an RDD checkpoint does not give - instead of recomputing the
    lineage, and a lost executor costs a re-read, not a recompute. There is
    one behaviour: a session of a cluster that names no folder is refused
    (``config.ensure_checkpoint_dir``). ``drop_tables`` removes what a job
    has written.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Remove this application's tables from the shared folder, to be called
    when the job's results are written or have failed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, ""))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
