"""Item-property history -> latest value per (item, property) -> wide items.

The latest value is found with an aggregate, ``max(struct(ts, value))``,
rather than a ``row_number`` window: the aggregate combines map-side, so an
item with a huge property history never lands whole in one task. Ties on
``ts`` go to the larger value, which makes the result independent of the
input order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.constants import PIVOT_KEYS
from cartwise.functions import clean_price, safe_int
from cartwise.operators.clean import with_ts


def union_properties(*parts: DataFrame) -> DataFrame:
    """Union the property parts by column name, epoch-ms -> ``ts``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_ts(out)


def latest_properties(props: DataFrame) -> DataFrame:
    """``(itemid, property, value)``: the value with the latest ``ts``."""
    return (with_ts(props).groupBy("itemid", "property")
            .agg(F.max(F.struct("ts", "value")).alias("_l"))
            .select("itemid", "property", F.col("_l.value").alias("value")))


def property_counts(latest: DataFrame, n: int | None = None) -> DataFrame:
    """Property keys by number of items, most frequent first; the first ``n``
    of them where the caller asks for a preview."""
    counts = (latest.groupBy("property").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc("property")))
    return counts if n is None else counts.limit(n)


def pivot_properties(latest: DataFrame, keys: Sequence[str] = PIVOT_KEYS) -> DataFrame:
    """Long ``(itemid, property, value)`` -> one row per item, one string
    column per key (the pivot values are fixed, so no extra job finds them)."""
    return latest.groupBy("itemid").pivot("property", list(keys)).agg(F.first("value"))


#: pivot key -> how its text becomes a value; other keys stay text
CONVERTERS = {"categoryid": safe_int, "available": safe_int, "price": clean_price}


def cast_item_columns(wide: DataFrame) -> DataFrame:
    """Type the known pivot columns. Every cast is a try-cast: dirty strings
    become null (ANSI mode stays on)."""
    return wide.select(*[CONVERTERS[c](c).alias(c) if c in CONVERTERS else F.col(c) for c in wide.columns])


def items_wide(props: DataFrame, keys: Sequence[str] = PIVOT_KEYS) -> DataFrame:
    """Latest value of each pivot key per item, typed, in one aggregate.

    Same answer as ``cast_item_columns(pivot_properties(latest_properties(p)))``
    restricted to ``keys``, but one shuffle instead of two. Items that hold
    none of the keys stay, with nulls.
    """
    keys = list(keys)
    wide = (with_ts(props).groupBy("itemid")
            .agg(*[F.max(F.when(F.col("property") == k, F.struct("ts", "value"))).alias(f"_{k}")
                   for k in keys])
            .select("itemid", *[F.col(f"_{k}.value").alias(k) for k in keys]))
    return cast_item_columns(wide)
