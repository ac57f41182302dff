"""Lazy inputs shared by the composed plans: the clean event log and the item
dimension built from the warehouse tables. Each frame is only planned when a
query asks for it (planning a DataFrame costs driver round-trips)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cartwise.constants import KEPT_EVENTS
from cartwise.operators.clean import clean_events
from cartwise.operators.items import items_wide, union_properties
from cartwise.plans.materialize import materialize
from cartwise.sources.tables import events_from_log, item_property_parts


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # The event model is defined in UTC (warehouse times are UTC wall
        # clock); hour-of-day, epoch conversions and session gaps depend on it.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    @cached_property
    def events_raw(self) -> DataFrame:
        """Warehouse events mapped to the event model, pre-filtered on the
        source column to the kept event types (pushed into the scan)."""
        return events_from_log(self.spark, self.sf_dir, keep=KEPT_EVENTS)

    @cached_property
    def events(self) -> DataFrame:
        return clean_events(self.events_raw)

    @cached_property
    def props(self) -> DataFrame:
        return union_properties(*item_property_parts(self.spark, self.sf_dir))

    @cached_property
    def items(self) -> DataFrame:
        """The item dimension, written once as a table: joins that read it
        get a plain shuffle on this side, so AQE can split a hot item on the
        other side when the dimension is too large to broadcast (an
        aggregate's output feeding a join directly cannot be split)."""
        return materialize(items_wide(self.props), "items")


def load_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(spark, sf_dir)
