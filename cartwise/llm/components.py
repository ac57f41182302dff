"""Connected components of a link table, as a loop of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.plans.materialize import materialize


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())


def _pull(links: DataFrame, name: str) -> DataFrame:
    """Every node of ``links`` (a, b) points to the least node among itself
    and its neighbours b. The minima are written first: both sides of the
    join are then plain scans, so Spark can split a hub's rows."""
    links = materialize(links, f"{name}-links")
    least = materialize(links.groupBy("a").agg(F.min("b").alias("m"))
                        .select("a", F.least("a", "m").alias("m")), f"{name}-least")
    return links.join(least, "a")


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b: long, not null) the
    least node that it can reach.

    Alternates two steps until nothing changes (a number of rounds that grows
    with the logarithm of the longest chain): larger neighbours move to the
    least neighbour, then smaller ones do. Each step's table is written to the
    shared folder, which cuts the lineage and survives a lost executor. An
    empty edge table gives an empty result; loops and repeated edges are
    ignored.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(max_rounds):
        pairs = materialize(pairs, f"{name}-pairs")
        now = _signature(pairs)
        if now == before or not now[0]:
            break
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _pull(both, f"{name}-large").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .filter("a <> b").distinct()
        small = _pull(large, f"{name}-small")
        pairs = (small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(small.select("a", F.col("m").alias("b")))
                 .filter("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
