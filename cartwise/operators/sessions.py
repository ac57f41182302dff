"""Sessions: a visitor's events split wherever the gap to the previous event
is more than ``gap_minutes`` whole minutes.

Rule (kept exactly): gap = (whole seconds of ts - whole seconds of the
previous ts) / 60.0; a visitor's first event opens session 1; an event opens
a new session when gap > gap_minutes; the session number is the running count
of openings ordered by ts with tied instants sharing one number.

Plan for scale. The rule only looks at whole seconds, so every event of a
visitor within one second shares the session of that second's first event,
and sessions are a function of the distinct (visitor, second) pairs:

1. one map-side-combined aggregate per (visitor, time bucket) holds the
   bucket's distinct seconds as a set: at most ``bucket_seconds`` numbers,
   whatever the number of events;
2. array functions find the seconds of the bucket that open a session inside
   it; a window per visitor over the bucket rows (one row per non-empty
   bucket, so bounded by the visitor's time span) tells whether the bucket's
   first second opens one, and how many sessions opened before it;
3. a bucket row then carries its opening seconds and the number of the session
   that it begins in. It is joined to the events on (visitor, bucket), and an
   event's session number is that number plus the openings up to its second.
   A hot key there is a plain equi-join key, which AQE splits.

Events are never windowed and cross the network once, in the join. The result
equals the rule for every bucket size (tests check it against SQL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.constants import EVENT_ADD, EVENT_TXN, EVENT_VIEW, SESSION_GAP_MINUTES
from cartwise.functions import count_if, session_key, whole_seconds

DEFAULT_BUCKET_SECONDS = 3600


def _bucket(second, bucket_seconds: int):
    # the second is never null here; saying so keeps null filters out of the join
    return F.coalesce(F.floor(second / F.lit(int(bucket_seconds))), F.lit(0))


def session_openings(events: DataFrame, gap_minutes: float = SESSION_GAP_MINUTES,
                     bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
                     user_col: str = "visitorid", ts_col: str = "ts") -> DataFrame:
    """``(visitor, _bkt, _base, _openings)``: per non-empty bucket, the number
    of sessions that opened before its first opening second, and those
    seconds in order."""
    def opens(later, earlier):
        return (later - earlier) / F.lit(60.0) > F.lit(float(gap_minutes))

    second = whole_seconds(ts_col)
    buckets = (events.filter(F.col(user_col).isNotNull() & F.col(ts_col).isNotNull())
               .groupBy(user_col, _bucket(second, bucket_seconds).alias("_bkt"))
               .agg(F.array_sort(F.collect_set(second)).alias("_secs")))
    inside = F.filter("_secs", lambda s, i: (i > 0) & opens(s, F.get("_secs", i - 1)))
    per_visitor = Window.partitionBy(user_col).orderBy("_bkt")
    first, last = F.get("_secs", F.lit(0)), F.element_at("_secs", -1)
    rows = buckets.select(user_col, "_bkt", first.alias("_first"), last.alias("_last"), inside.alias("_inside"))
    previous = F.lag("_last").over(per_visitor)
    rows = rows.withColumn("_openings", F.when(
        previous.isNull() | opens(F.col("_first"), previous),
        F.concat(F.array("_first"), "_inside")).otherwise(F.col("_inside")))
    before = F.sum(F.size("_openings")).over(per_visitor.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(user_col, "_bkt", F.coalesce(before, F.lit(0)).alias("_base"), "_openings")


def sessionize(events: DataFrame, gap_minutes: float = SESSION_GAP_MINUTES,
               bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
               user_col: str = "visitorid", ts_col: str = "ts") -> DataFrame:
    """Add ``session_seq`` (long, from 1) and ``session_id`` (``visitor-seq``).
    Rows without a visitor or time have no session and are dropped."""
    openings = session_openings(events, gap_minutes, bucket_seconds, user_col, ts_col)
    second = whole_seconds(ts_col)
    placed = events.filter(F.col(ts_col).isNotNull()) \
        .withColumn("_bkt", _bucket(second, bucket_seconds)).join(openings, [user_col, "_bkt"])
    begun = F.size(F.filter("_openings", lambda o: o <= second))
    return (placed.withColumn("session_seq", (F.col("_base") + begun).cast("long"))
            .select(*events.columns, "session_seq", session_key(user_col, "session_seq").alias("session_id")))


def session_item_rollup(sessionised: DataFrame, user_col: str = "visitorid") -> DataFrame:
    """One row per (visitor, session, item) with per-pair counts. Shared first
    level of the session features and the purchase labels: a single
    map-side-combined aggregate, so a session with many items spreads over
    many tasks."""
    ev = F.col("event")
    return (sessionised.groupBy(user_col, "session_seq", "itemid")
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 count_if(ev == EVENT_VIEW).alias("n_views"),
                 count_if(ev == EVENT_ADD).alias("n_adds"),
                 count_if(ev == EVENT_TXN).alias("n_txns")))


def session_counts(sessionised: DataFrame, user_col: str = "visitorid") -> DataFrame:
    """Per session: views, adds, transactions - one map-side-combined
    aggregate straight from the events (no item level), for reports that do
    not need the distinct-item counts."""
    ev = F.col("event")
    return (sessionised.groupBy(user_col, "session_seq")
            .agg(count_if(ev == EVENT_VIEW).alias("views"), count_if(ev == EVENT_ADD).alias("adds"),
                 count_if(ev == EVENT_TXN).alias("txns"))
            .withColumn("session_id", session_key(user_col, "session_seq")))


def session_features(sessionised: DataFrame, user_col: str = "visitorid",
                     rollup: DataFrame | None = None) -> DataFrame:
    """Per session: start, end, views, adds, transactions, distinct items,
    distinct items viewed, duration in minutes (whole seconds), hour of start.

    Distinct counts come from the (session, item) rollup instead of
    ``countDistinct``; that avoids Spark's Expand for two distinct aggregates.
    Grouping is by (visitor, session number); the string key is built last.
    """
    r = rollup if rollup is not None else session_item_rollup(sessionised, user_col)
    out = (r.groupBy(user_col, "session_seq")
           .agg(F.min("first_ts").alias("session_start"), F.max("last_ts").alias("session_end"),
                F.sum("n_views").alias("views"), F.sum("n_adds").alias("adds"),
                F.sum("n_txns").alias("txns"),
                F.count("itemid").alias("unique_items"),
                count_if((F.col("n_views") > 0) & F.col("itemid").isNotNull()).alias("distinct_products")))
    return out.select(
        session_key(user_col, "session_seq").alias("session_id"), user_col, "session_seq",
        "session_start", "session_end", "views", "adds", "txns", "unique_items", "distinct_products",
        ((whole_seconds("session_end") - whole_seconds("session_start")) / F.lit(60.0)).alias("duration_min"),
        F.hour("session_start").alias("session_hour"),
    )
