"""Largest task (shuffle records read) when one visitor holds half of the log.

Builds a generated log with Spark (half the rows from one visitor inside ten
minutes, the rest spread over 10,000 visitors and a month), runs
``sessionize`` and the single-window rule with broadcasts off, and reads the
per-task shuffle-read counts from Spark's event log in a scratch folder
(AQE partition coalescing off, so task sizes show the key distribution).
Usage: python tools/skew_check.py [rows]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    n = int(args[0]) if args else 2_000_000
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cartwise.config import build_session
    from cartwise.operators import sessions

    log_dir = tempfile.mkdtemp(prefix="run-skew-")
    spark = build_session("local[8]", shuffle_partitions=64, extra_conf={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    t0 = 1704067200
    ev = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 10000 + 1).alias("visitorid"),
        F.lit("view").alias("event"), (F.col("id") % 97).cast("int").alias("itemid"),
        F.timestamp_seconds(F.when(F.col("id") % 2 == 0, t0 + F.col("id") % 600)
                            .otherwise(t0 + (F.col("id") * 7919) % (30 * 86400))).alias("ts"))
    def single_window(events):
        w = Window.partitionBy("visitorid").orderBy("ts")
        gap = F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w))
        return events.withColumn("session_seq", F.sum(F.when(gap <= 1800, 0).otherwise(1)).over(w))

    for name, fn in (("bucketed", sessions.sessionize), ("single_window", single_window)):
        spark.sparkContext.setJobGroup(name, name)
        fn(ev).write.format("noop").mode("overwrite").save()

    # training frame with a hot visitor AND a hot item (half the events on item 0);
    # the skew threshold is lowered so AQE's split engages at this size
    from cartwise.plans.intent import build_training_frame
    hot = ev.withColumn("itemid", F.when(F.col("visitorid") % 2 == 1, F.lit(0)).otherwise(F.col("itemid")))
    items = spark.range(100).select(F.col("id").cast("int").alias("itemid"),
                                    (F.col("id") % 7).cast("int").alias("categoryid"))
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", str(256 * 1024))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(256 * 1024))
    for name, on in (("training_frame_skew_split", "true"), ("training_frame_no_split", "false")):
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", on)
        spark.sparkContext.setJobGroup(name, name)
        build_training_frame(hot, items, cut_lineage=False).write.format("noop").mode("overwrite").save()
    spark.stop()

    import zstandard
    f = glob.glob(os.path.join(log_dir, "*", "events_*"))[0]
    raw = open(f, "rb").read()
    try:
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    except zstandard.ZstdError:
        pass
    group_of_stage, worst, per_stage = {}, {}, {}
    for line in io.StringIO(raw.decode()):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for s in e["Stage IDs"]:
                group_of_stage[s] = g
        elif e["Event"] == "SparkListenerTaskEnd":
            g = group_of_stage.get(e["Stage ID"])
            rec = e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
            if g:
                worst[g] = max(worst.get(g, 0), rec)
                key = (g, e["Stage ID"])
                tot, mx, cnt = per_stage.get(key, (0, 0, 0))
                per_stage[key] = (tot + rec, max(mx, rec), cnt + 1)
    print(json.dumps({"rows": n, "hot_visitor_rows": n // 2, "largest_task_shuffle_records": worst}))
    if "-v" in sys.argv:
        for (g, sid), (tot, mx, cnt) in sorted(per_stage.items(), key=lambda kv: kv[0][1]):
            if tot:
                print(f"{g:28s} stage {sid:4d} tasks {cnt:4d} records {tot:9d} largest {mx:8d}")


if __name__ == "__main__":
    main()
