"""Structured Streaming entry points for the same operators.

The batch job is the primary path; these functions let a live event log or a
feed of feature rows go through the *same* operators without a batch
re-run. Nothing here adds behaviour of its own:

* ``event_counts_stream`` - the event-type report (clean + count) over a file
  stream, complete mode;
* ``score_stream`` - a fitted pipeline applied to streaming rows, with the
  ``p1`` / ``p_max`` columns; every stage the library fits (indexers,
  one-hot, assembler, scaler, LR/RF models) is a stateless transformer, so
  ``transform`` works on a streaming frame;
* ``write_stream`` - append to Parquet with the checkpoint under the
  session's shared checkpoint folder, so a restarted query resumes exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cartwise.config import checkpoint_dir
from cartwise.operators.clean import clean_events
from cartwise.operators.reports import event_counts
from cartwise.operators.scoring import add_probabilities


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def event_counts_stream(events_stream: DataFrame) -> DataFrame:
    """Running count per event type of the cleaned stream (complete mode)."""
    return event_counts(clean_events(events_stream))


def score_stream(model, rows_stream: DataFrame) -> DataFrame:
    """Score streaming rows with a fitted pipeline; adds ``p1`` and ``p_max``."""
    return add_probabilities(model.transform(rows_stream))


def write_stream(df: DataFrame, path: str, name: str, mode: str = "append", fmt: str = "parquet",
                 trigger_once: bool = False):
    """Start a sink whose checkpoint sits in the shared checkpoint folder."""
    base = checkpoint_dir(df.sparkSession)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; a streaming sink needs a shared checkpoint folder")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/streams/{name}")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.format(fmt).start(path)
