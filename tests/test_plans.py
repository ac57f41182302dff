"""Physical-plan properties the design relies on."""

import os

import pytest

import __spark_entry__ as E
from cartwise.ml import model as M
from cartwise.operators import scoring
from cartwise.plans.inputs import load_inputs
from cartwise.plans.intent import run_intent
from cartwise.sources import sinks

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_filter_reaches_the_scan(spark):
    p = plan_of(load_inputs(spark, SMALL).events)
    assert "PushedFilters: [IsNotNull(ts), In(event_type" in p


def test_scans_are_pruned(spark):
    from cartwise.operators.items import items_wide
    p = plan_of(items_wide(load_inputs(spark, SMALL).props))
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>" in p
    assert "p_name" not in p
    p = plan_of(load_inputs(spark, SMALL).events.select("visitorid", "ts"))
    assert "value" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id % 10 as string) as session_id", "cast(id as int) as itemid",
                                      "rand(1) as p1")
    p = plan_of(scoring.top_k(df, 5))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_no_python_in_sql_checked_queries(spark):
    qs, orc = E.queries(), E.oracle_sql()
    trained = {n for n in orc if n.startswith(("score_", "train_", "app_", "session_intent_", "model_", "csv_"))}
    for name in set(orc) - trained:         # fits and writes are jobs of their own
        p = plan_of(qs[name](spark, SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_sessions_take_four_shuffles(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(E.queries()["sessionize_30m"](spark, SMALL))
        assert p.count("Exchange hashpartitioning") <= 4 and p.count("FileScan parquet") == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_ranking_reports_start_from_the_pairs(spark):
    for name in ("top_k_per_session", "confusion_matrix", "score_histogram"):
        p = plan_of(E.queries()[name](spark, SMALL))
        assert "part.parquet" not in p and "/tables/" not in p, name


def test_intent_job_end_to_end(spark, scratch):
    inp = load_inputs(spark, SMALL)
    run = run_intent(inp.events, inp.items, out_dir=scratch, name="lr")
    assert set(run.metrics) == {"auroc", "auprc", "auprc_p1"}
    top = sinks.read_published(spark, os.path.join(scratch, "purchase_intent_top5_lr"))
    assert top.columns == ["session_id", "itemid", "p_buy"]
    assert top.groupBy("session_id").count().filter("count > 5").count() == 0
    assert top.count() == run.topk.count()
    reloaded = M.load(os.path.join(scratch, "models", "lr_pipeline"))
    assert reloaded.transform(run.xy).count() == run.xy.count()
    cm = {(r.label, r.pred): r["count"] for r in run.confusion.collect()}
    assert sum(cm.values()) == run.preds.count()


def test_run_models_share_one_split(spark, scratch):
    from cartwise.plans.intent import run_models
    inp = load_inputs(spark, SMALL)
    runs = run_models(inp.events, inp.items, {"lr": M.logistic(), "rf": M.forest(num_trees=4, max_depth=4)},
                      out_dir=scratch)
    assert set(runs) == {"lr", "rf"}
    assert runs["lr"].cutoff == runs["rf"].cutoff
    assert runs["lr"].topk.count() == runs["rf"].topk.count()
    assert os.path.isdir(os.path.join(scratch, "purchase_intent_top5_rf"))
    assert os.path.isdir(os.path.join(scratch, "models", "rf_pipeline"))


def test_scale_conf_sizes_partitions():
    from cartwise.config import scale_conf
    c = scale_conf(4 * 2**40, total_cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 32768
    small = scale_conf(10 * 2**20, total_cores=64)
    assert int(small["spark.sql.shuffle.partitions"]) == 192


def test_batch_job_on_warehouse_and_csv(spark, scratch):
    from cartwise.plans.job import main
    out = os.path.join(scratch, "gold")
    m = main(["--warehouse", SMALL, "--out", out, "--models", "lr,rf", "--rf-trees", "3", "--rf-depth", "3"],
             spark=spark)
    assert set(m) == {"lr", "rf"} and 0.0 <= m["lr"]["auroc"] <= 1.0
    assert spark.read.json(os.path.join(out, "metrics")).count() == 2
    assert sinks.read_published(spark, os.path.join(out, "purchase_intent_top5_rf")).count() > 0
    # the CSV layout: events + two property parts
    d = os.path.join(scratch, "csv")
    os.makedirs(d)
    with open(os.path.join(d, "events.csv"), "w") as f:
        f.write("timestamp,visitorid,event,itemid,transactionid\n")
        t = 1433221332000
        for i in range(60):
            ev = ["view", "addtocart", "transaction"][i % 3]
            f.write(f"{t + i * 600_000},{i % 7},{ev},{i % 5},\n")
    for j, name in enumerate(("item_properties_part1.csv", "item_properties_part2.csv")):
        with open(os.path.join(d, name), "w") as f:
            f.write("timestamp,itemid,property,value\n")
            for item in range(5):
                f.write(f"{1435460400000 + j},{item},categoryid,{100 + item % 2}\n")
    m2 = main(["--data-dir", d, "--out", os.path.join(scratch, "gold2"), "--models", "lr"], spark=spark)
    assert set(m2) == {"lr"}


def test_hot_visitor_and_hot_item_joins_are_split_by_aqe(spark):
    from pyspark.sql import functions as F
    from cartwise.plans.intent import build_training_frame
    n = 40000
    hot = F.col("id") % 3 == 0          # a third of the events: one visitor, one session per event
    ev = spark.range(n).select(
        F.when(hot, F.lit(0)).otherwise(F.col("id") % 997).alias("visitorid"), F.lit("view").alias("event"),
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise((F.col("id") % 300).cast("int")).alias("itemid"),
        F.timestamp_seconds(F.lit(1704067200) + F.when(hot, F.col("id") * 3600)
                            .otherwise((F.col("id") * 7919) % (30 * 86400))).alias("ts"))
    items = spark.range(300).select(F.col("id").cast("int").alias("itemid"), (F.col("id") % 7).alias("categoryid"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        xy = build_training_frame(ev, items, cut_lineage=False)
        xy.collect()
        final = xy._jdf.queryExecution().executedPlan().toString()
        skew_joins = [ln for ln in final.splitlines()
                      if "SortMergeJoin(skew=true)" in ln or "isSkewJoin=true" in ln]
        assert any("[itemid" in ln for ln in skew_joins), "hot-item join was not split"
        assert any("[visitorid" in ln and "session_seq" not in ln for ln in skew_joins), \
            "hot-visitor join was not split"
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_item_event_join_is_split_with_written_dimension(spark):
    from pyspark.sql import functions as F
    from cartwise.operators import features, items as I
    from cartwise.plans.materialize import materialize
    ev = spark.range(40000).select(
        (F.col("id") % 997).alias("visitorid"), F.lit("view").alias("event"),
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise((F.col("id") % 300).cast("int")).alias("itemid"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("id") * 7919) % (30 * 86400)).alias("ts"))
    props = spark.range(300).select(F.lit(1704067200000).alias("timestamp"), F.col("id").cast("int").alias("itemid"),
                                    F.lit("categoryid").alias("property"), (F.col("id") % 7).cast("string").alias("value"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = features.enrich_events(ev, materialize(I.items_wide(props), "items"))
        df.collect()
        assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_materialize_writes_a_table_and_drops_it(spark):
    from cartwise.plans.materialize import drop_tables, materialize, scratch_path
    written = materialize(spark.range(50), "t")
    assert not written.is_cached and "/tables/t-" in written.inputFiles()[0]
    assert materialize(spark.range(50), "t").inputFiles() != written.inputFiles()
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, ""))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(folder)
    drop_tables(spark)
    assert not fs.exists(folder)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    import cartwise.config as config

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
    monkeypatch.setattr(config, "checkpoint_dir", lambda s: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        config.ensure_checkpoint_dir(Cluster)
    Cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        config.ensure_checkpoint_dir(Cluster)


def test_a_query_leaves_the_checkpoint_folder_alone(spark):
    from cartwise.config import ensure_checkpoint_dir
    before = ensure_checkpoint_dir(spark)
    E.queries()["session_intent_model"](spark, SMALL).count()
    assert ensure_checkpoint_dir(spark) == before
