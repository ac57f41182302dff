"""Ingest cleaning: epoch-ms to timestamp, required columns, kept event types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cartwise.constants import KEPT_EVENTS
from cartwise.functions import epoch_ms_to_ts
from cartwise.sources.schemas import EVENT_REQUIRED


def with_ts(df: DataFrame, epoch_col: str = "timestamp") -> DataFrame:
    """Replace an epoch-millisecond column by a ``ts`` timestamp column.
    Frames that already carry ``ts`` pass through."""
    if epoch_col in df.columns and isinstance(df.schema[epoch_col].dataType, NumericType):
        return df.withColumn("ts", epoch_ms_to_ts(epoch_col)).drop(epoch_col)
    return df


def _required(df: DataFrame, required: Sequence[str]) -> Sequence[str]:
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are absent: {', '.join(absent)}")
    return required


def clean_events(events_raw: DataFrame, kept: Sequence[str] = KEPT_EVENTS,
                 required: Sequence[str] = EVENT_REQUIRED) -> DataFrame:
    """Timestamp conversion, drop rows missing a required column, keep only
    the listed event types. Both filters are simple predicates, so Catalyst
    pushes them into the scan."""
    df = with_ts(events_raw)
    cond = F.col("event").isin(*kept)
    for c in _required(df, required):
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def dropped_row_count(events_raw: DataFrame, required: Sequence[str] = EVENT_REQUIRED) -> DataFrame:
    """One-row report: rows dropped for a missing required column."""
    df = with_ts(events_raw)
    missing = F.lit(False)
    for c in _required(df, required):
        missing = missing | F.col(c).isNull()
    return df.agg(F.count(F.when(missing, 1)).alias("dropped_nulls"), F.count(F.lit(1)).alias("rows"))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null."""
    return df.dropna(how="all")
