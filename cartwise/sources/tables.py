"""Adapters from the shared warehouse tables to the clickstream layouts.

The warehouse holds ``events(event_id, ts, user_id, event_type, value, props)``
and ``part(p_partkey, ..., p_size, p_retailprice)``. These functions re-shape
them, lazily and column-for-column, into the event log and the two
item-property parts the operators expect. Everything is a projection or an
unpivot of the scanned tables, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (mapping of warehouse event types onto the event model) ---
EVENT_TYPE_MAP = (("view", "view"), ("click", "addtocart"), ("purchase", "transaction"))
# item-property versions, both covering every item of ``part``:
#   part 1 at PROPS_T0_MS: categoryid = p_size; available = 0 for ECONOMY
#     parts, else 1; price = "n" + price, but "n/a" for NO_PRICE_BRAND;
#   part 2: price = "n" + (price + 1) at PROPS_T0_MS + (p_size - 25) days, so
#     sizes above 25 carry a newer price, below 25 an older one, and size 25 a
#     same-instant tie (settled by the larger value).
#   Items of BARE_SIZE hold none of the pivot keys, only another property;
#   the categoryid of FRACTION_SIZE items has a fraction (cut by the cast).
PROPS_T0_MS = 1704067200000
DAY_MS = 86400000
PIVOT_SIZE = 25
NO_PRICE_BRAND = "Brand#13"
UNAVAILABLE_TYPE = "ECONOMY"
BARE_SIZE, BARE_PROPERTY = 2, "888"
FRACTION_SIZE, FRACTION = 1, ".7"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_from_log(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """Event log with ``visitorid, event, itemid, ts, transactionid``.

    ``ts`` is already a timestamp here (the warehouse stores microseconds),
    so the epoch-ms conversion of the CSV path is not needed. ``keep`` (event
    model types) adds the same filter on the *source* column, where it is a
    plain IN that reaches the Parquet scan (row groups are skipped by their
    statistics); a filter on the mapped column cannot be pushed.
    """
    ev = table(spark, sf_dir, "events")
    if keep is not None:
        src = [s for s, d in EVENT_TYPE_MAP if d in keep]
        unmapped = [k for k in keep if k not in {s for s, _ in EVENT_TYPE_MAP}]
        ev = ev.filter(F.col("event_type").isin(*(src + unmapped)))
    return map_events(ev)


def map_events(ev: DataFrame) -> DataFrame:
    """Warehouse event rows -> event model columns (works on batch and
    streaming frames alike: projection only)."""
    expr = None
    for src, dst in EVENT_TYPE_MAP:
        expr = (F.when(F.col("event_type") == src, F.lit(dst)) if expr is None
                else expr.when(F.col("event_type") == src, F.lit(dst)))
    mapped = expr.otherwise(F.col("event_type"))
    return ev.select(
        F.col("user_id").alias("visitorid"),
        mapped.alias("event"),
        F.get_json_object("props", "$.k").try_cast("int").alias("itemid"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase",
               F.col("event_id").cast("string")).alias("transactionid"),
    )


def item_property_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two item-property parts (``timestamp, itemid, property, value``) derived
    from every row of ``part`` (see the fixed values above)."""
    part = table(spark, sf_dir, "part")
    price0 = F.when(F.col("p_brand") == NO_PRICE_BRAND, F.lit("n/a")).otherwise(
        F.concat(F.lit("n"), F.col("p_retailprice").cast("decimal(10,2)").cast("string")))
    category = F.concat(F.col("p_size").cast("string"),
                        F.when(F.col("p_size") == FRACTION_SIZE, F.lit(FRACTION)).otherwise(F.lit("")))

    def key(name):
        return F.when(F.col("p_size") == BARE_SIZE, F.lit(BARE_PROPERTY)).otherwise(F.lit(name))

    available = F.when(F.col("p_type") == UNAVAILABLE_TYPE, F.lit("0")).otherwise(F.lit("1"))
    p1 = part.select(
        F.lit(PROPS_T0_MS).alias("timestamp"),
        F.col("p_partkey").cast("int").alias("itemid"),
        F.inline(F.array(
            F.struct(key("categoryid").alias("property"), category.alias("value")),
            F.struct(key("available").alias("property"), available.alias("value")),
            F.struct(key("price").alias("property"), price0.alias("value")),
        )),
    )
    p2 = part.select(
        (F.lit(PROPS_T0_MS) + (F.col("p_size") - PIVOT_SIZE).cast("long") * F.lit(DAY_MS)).alias("timestamp"),
        F.col("p_partkey").cast("int").alias("itemid"),
        key("price").alias("property"),
        F.concat(F.lit("n"), (F.col("p_retailprice") + 1).cast("decimal(10,2)").cast("string")).alias("value"),
    )
    return p1, p2
