"""Sharding by fixed virtual slots, in DataFrame functions alone.

Records are hashed into ``n_slots`` virtual slots, once and for all. Bytes and
records are summed per slot, and a slot-to-shard map assigns whole slots to
shards so that the shards' bytes are near equal. The map is a small versioned
table in a folder of its own; rebalancing writes its next version, in which
only the slots that must move have another shard. Records never need
rehashing.

The law that holds is ``bytes``. The map has ``n_slots`` rows whatever the
data, so it is broadcast. A record's place in its shard is its slot's first
place (from the per-slot counts) plus its place in its slot: rows are numbered
within thousands of slots, never within a shard.

Defined results: null text counts as empty (size 8); the hash takes id and
text, so a repeated id does not make a hot slot; equal rows share a slot and
get different places; ties in a slot's order are between equal rows; an empty
table gives an empty result with all slots in the map; extra columns are kept
by ``assign`` unless named like its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.plans.materialize import materialize, scratch_path

N_SLOTS = 4_096
N_SHARDS = 24
ROW_BYTES = 8
MAP = "array<struct<slot:int,shard:int>>"


def record_slot(id_col: str, text_col: str, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(id_col, text_col), F.lit(n_slots)).cast("int")


def record_size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES


def slot_sizes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(slot, bytes, n) for every slot; ``records`` has virtual_slot and size."""
    used = records.groupBy(F.col("virtual_slot").alias("slot")) \
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(used, "slot", "left").select(
        "slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def _pack(slots: Column, loads: Column) -> Column:
    """Largest slot first, each to the shard with the least bytes so far."""
    def step(acc, s):
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(acc["loads"], lambda x, i: F.when(i == to, x + s["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"),
                        F.array_append(acc["map"], F.struct(s["slot"].alias("slot"), to.alias("shard"))).alias("map"))

    begin = F.struct(loads.alias("loads"), F.array().cast(MAP).alias("map"))
    largest_first = F.array_sort(F.transform(slots, lambda s: F.struct(
        (-s["bytes"]).alias("back"), s["slot"].alias("slot"), s["bytes"].alias("bytes"))))
    return F.aggregate(largest_first, begin, step, lambda acc: acc["map"])


def new_map(sizes: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1 of a map: (slot, shard, version)."""
    slots = F.collect_list(F.struct("slot", "bytes"))
    empty = F.array_repeat(F.lit(0).cast("long"), n_shards)
    return sizes.agg(slots.alias("slots")).select(F.inline(_pack(F.col("slots"), empty))) \
        .withColumn("version", F.lit(1))


def rebalance(old: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of ``old`` for the sizes of today and ``n_shards``.

    A shard keeps its slots, smallest first, while they fit its even share;
    only the others, few and large (and those of shards that are no more) move, each to the
    shard with the least bytes."""
    have = old.join(sizes, "slot")
    share = F.sum("bytes").over(Window.partitionBy()) / n_shards
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "slot")
                                 .rowsBetween(Window.unboundedPreceding, 0))
    stays = (F.col("shard") < n_shards) & (filled <= share)
    marked = have.withColumn("stays", stays)
    loads = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.aggregate(
        F.filter("kept", lambda k: k["shard"] == i), F.lit(0).cast("long"), lambda a, k: a + k["bytes"]))
    both = marked.agg(
        F.collect_list(F.when(F.col("stays"), F.struct("slot", "shard", "bytes"))).alias("kept"),
        F.collect_list(F.when(~F.col("stays"), F.struct("slot", "bytes"))).alias("moved"),
        (F.max("version") + 1).alias("version"))
    placed = F.concat(F.transform("kept", lambda k: F.struct(k["slot"].alias("slot"), k["shard"].alias("shard"))),
                      _pack(F.col("moved"), loads))
    return both.select("version", F.inline(placed)).select("slot", "shard", "version")


def write_map(mapping: DataFrame, folder: str) -> None:
    """Add ``mapping`` to the folder as a version of its own; an existing
    version is never overwritten (the write fails)."""
    version = mapping.select("version").first()["version"]
    mapping.select("slot", "shard").coalesce(1).write.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The named version of the folder's map, by default the latest."""
    every = spark.read.schema("slot int, shard int, version int").parquet(folder)
    wanted = version if version is not None else every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == wanted)


def assign(df: DataFrame, mapping: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           n_slots: int = N_SLOTS) -> DataFrame:
    """``df`` with ``virtual_slot`` and ``shard``; one map over the table."""
    slotted = df.drop("virtual_slot", "shard").withColumn("virtual_slot", record_slot(id_col, text_col, n_slots))
    shard_of = mapping.select(F.col("slot").alias("virtual_slot"), "shard")
    return slotted.join(F.broadcast(shard_of), "virtual_slot").select(*slotted.columns, "shard")


def write_shards(df: DataFrame, mapping: DataFrame, path: str, **columns) -> None:
    """All columns, one folder per shard."""
    assign(df, mapping, **columns).write.partitionBy("shard").parquet(path)


def shard_places(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS,
                 n_shards: int = N_SHARDS, folder: str | None = None) -> DataFrame:
    """One row per record: id, size, text_crc32, virtual_slot, shard, slot
    (place in the shard, gapless from 0). Writes version 1 of the map to
    ``folder`` (by default in the shared scratch folder)."""
    import uuid

    spark = df.sparkSession
    folder = folder or scratch_path(spark, f"slot-map-{uuid.uuid4().hex}")
    records = materialize(df.select(
        F.col(id_col).alias("id"), record_size(text_col).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        record_slot(id_col, text_col, n_slots).alias("virtual_slot")), "shard-records")
    sizes = materialize(slot_sizes(records, n_slots), "slot-sizes")
    write_map(new_map(sizes, n_shards), folder)
    # n_slots rows: where each slot's records begin in its shard
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = read_map(spark, folder).join(sizes, "slot") \
        .select(F.col("slot").alias("virtual_slot"), "shard", F.coalesce(first, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size")) - 1
    return records.withColumn("place", place).join(F.broadcast(starts), "virtual_slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"))
