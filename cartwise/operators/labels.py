"""Purchase labels on (session, item) candidate pairs.

A candidate is any (session, item) the visitor touched (view, addtocart or
transaction); its label is 1 when the session holds a transaction of that
item. Every purchased pair is also a touched pair, so the left join of the
candidates with the purchased pairs is the same as one aggregate with
``max(is transaction)`` - one map-side-combined shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.constants import EVENT_TXN, KEPT_EVENTS
from cartwise.functions import session_key
from cartwise.operators.sessions import session_item_rollup


def touches(sessionised: DataFrame) -> DataFrame:
    return sessionised.filter(F.col("event").isin(*KEPT_EVENTS))


def purchased_pairs(sessionised: DataFrame) -> DataFrame:
    """Distinct (session_id, itemid) with a transaction, label 1."""
    return (sessionised.filter(F.col("event") == EVENT_TXN)
            .select("session_id", "itemid").dropDuplicates()
            .withColumn("label", F.lit(1)))


def candidates(sessionised: DataFrame, user_col: str = "visitorid") -> DataFrame:
    """Distinct (session_id, visitorid, itemid) touched in the session. (The
    last touch of each pair keeps only these columns, so any touch does.)"""
    return touches(sessionised).select("session_id", user_col, "itemid").dropDuplicates()


def label_candidates(sessionised: DataFrame, user_col: str = "visitorid",
                     rollup: DataFrame | None = None) -> DataFrame:
    """``session_id, visitorid, itemid, label`` (label int 0/1), plus the
    grouping key ``session_seq``."""
    r = rollup if rollup is not None else session_item_rollup(touches(sessionised), user_col)
    return r.select(session_key(user_col, "session_seq").alias("session_id"), user_col,
                    "session_seq", "itemid",
                    (F.col("n_txns") > 0).cast("int").alias("label"))


def session_intent(session_feats: DataFrame) -> DataFrame:
    """Session-level purchase intent: 1 when the session has a transaction."""
    return session_feats.select("session_id", (F.col("txns") > 0).cast("int").alias("purchase_intent"))
