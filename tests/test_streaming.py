import os

from pyspark.sql import functions as F

from cartwise.ml import model as M
from cartwise.operators.reports import event_counts
from cartwise.plans.inputs import load_inputs
from cartwise.sources.tables import map_events
from cartwise.streaming import event_counts_stream, read_stream, score_stream, write_stream

SMALL = "/root/testdata/sf0.001"


def test_event_counts_stream_matches_batch(spark, scratch):
    # stream the warehouse events file through the same mapping as the batch path
    raw_schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    src = read_stream(spark, SMALL, raw_schema, glob="events.parquet")
    mapped = map_events(src)
    q = event_counts_stream(mapped).writeStream.outputMode("complete").format("memory").queryName("ev_counts_test").start()
    q.processAllAvailable()
    got = {r.event: r["count"] for r in spark.sql("SELECT * FROM ev_counts_test").collect()}
    q.stop()
    want = {r.event: r["count"] for r in event_counts(load_inputs(spark, SMALL).events).collect()}
    assert got == want


def test_score_stream(spark, scratch):
    rows = spark.createDataFrame([(float(i % 5), i % 2) for i in range(60)], "views double, label int")
    model = M.train_intent(rows.withColumn("adds", F.lit(0.0)), M.logistic(), num_cols=["views", "adds"],
                           cat_cols=[])
    d = os.path.join(scratch, "feed")
    rows.withColumn("adds", F.lit(0.0)).write.parquet(d)
    src = read_stream(spark, d, spark.read.parquet(d).schema)
    q = score_stream(model, src).select("views", "p1", "p_max").writeStream.format("memory").queryName("scored_test").start()
    q.processAllAvailable()
    n = spark.sql("SELECT count(*) AS n, min(p1) AS lo, max(p1) AS hi FROM scored_test").first()
    q.stop()
    assert n.n == 60 and 0.0 <= n.lo <= n.hi <= 1.0


def test_parquet_sink_resumes_from_checkpoint(spark, scratch):
    src_dir = os.path.join(scratch, "in")
    out_dir = os.path.join(scratch, "out")
    spark.range(10).selectExpr("id", "cast(id as double) as views").write.parquet(os.path.join(src_dir, "a"))
    schema = spark.read.parquet(os.path.join(src_dir, "a")).schema
    stream = lambda: read_stream(spark, os.path.join(src_dir, "*"), schema)
    q = write_stream(stream(), out_dir, "resume_test", trigger_once=True)
    q.awaitTermination()
    assert spark.read.parquet(out_dir).count() == 10
    spark.range(10, 15).selectExpr("id", "cast(id as double) as views").write.parquet(os.path.join(src_dir, "b"))
    q = write_stream(stream(), out_dir, "resume_test", trigger_once=True)   # same checkpoint: only new files
    q.awaitTermination()
    assert spark.read.parquet(out_dir).count() == 15
