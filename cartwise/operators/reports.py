"""Behaviour reports: counts, time range, funnel, category conversion,
activity by hour. All are aggregates with map-side combine; none collects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("count"))


def time_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def label_balance(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def purchase_funnel(session_feats: DataFrame) -> DataFrame:
    """Sessions with a view; of those, with an add-to-cart; of those, with a
    transaction (order inside the session not required); step rates."""
    v = F.col("views") > 0
    a = v & (F.col("adds") > 0)
    t = a & (F.col("txns") > 0)
    out = session_feats.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count(F.when(v, 1)).alias("viewed"),
        F.count(F.when(a, 1)).alias("carted"),
        F.count(F.when(t, 1)).alias("purchased"))
    return out.select(
        "sessions", "viewed", "carted", "purchased",
        F.when(F.col("viewed") > 0, F.col("carted") / F.col("viewed")).alias("view_to_cart"),
        F.when(F.col("carted") > 0, F.col("purchased") / F.col("carted")).alias("cart_to_purchase"))


def category_conversion(labeled: DataFrame, items: DataFrame) -> DataFrame:
    """Per category (null kept as its own row): labelled pairs, purchased
    pairs, and their ratio."""
    j = labeled.join(items.select("itemid", "categoryid"), "itemid", "left")
    return (j.groupBy("categoryid")
            .agg(F.count(F.lit(1)).alias("pairs"),
                 F.sum("label").cast("long").alias("purchases"))
            .withColumn("conversion_rate", F.col("purchases") / F.col("pairs")))


def activity_by_hour(events: DataFrame) -> DataFrame:
    """Events per hour of day (session zone) and event type."""
    return (events.groupBy(F.hour("ts").alias("hour"), "event")
            .agg(F.count(F.lit(1)).alias("events")))

