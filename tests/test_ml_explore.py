import os

import pytest
from pyspark.sql import functions as F

from cartwise.constants import NUM_COLS
from cartwise.ml import model as M
from cartwise.ml.score import predictions_from, score, score_from_saved, score_view
from cartwise.operators import explore
from cartwise.sources import read_any, read_events, read_item_properties, sinks, validate

@pytest.fixture(scope="module")
def feature_rows(spark):
    """Labelled feature rows: counts from a hash of the row number, the label
    from a noisy rule over them."""
    rows = spark.range(200).select(
        F.concat_ws("-", (F.col("id") % 90).cast("string"), F.lit("1")).alias("session_id"),
        (F.col("id") + 100).cast("int").alias("itemid"),
        *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(9)).cast("double" if c == "duration_min" else "int").alias(c)
          for c in NUM_COLS],
        (F.col("id") % 11 + 500).cast("int").alias("categoryid"))
    noise = F.pmod(F.xxhash64("itemid"), F.lit(5)) == 0
    return rows.withColumn("label", ((F.col("adds") + F.col("u_txn") > 8) != noise).cast("int"))


def test_logistic_pipeline_probabilities_and_save_load(spark, feature_rows, scratch):
    model = M.train_intent(feature_rows, M.logistic())
    preds = score(model, feature_rows)
    rows = preds.select("probability", "p1", "p_max").collect()
    for r in rows:
        assert 0.0 <= r.p1 <= 1.0 and abs(sum(r.probability) - 1.0) < 1e-9
    path = os.path.join(scratch, "lr_pipeline")
    M.save(model, path)
    again = score_from_saved(path, feature_rows).select("session_id", "itemid", "p1").orderBy("session_id", "itemid")
    first = preds.select("session_id", "itemid", "p1").orderBy("session_id", "itemid")
    assert [r.p1 for r in again.collect()] == pytest.approx([r.p1 for r in first.collect()])
    met = M.evaluate_binary(preds)
    assert 0.5 <= met["auroc"] <= 1.0
    for source in (model, path, model.transform(feature_rows)):
        found = predictions_from(source, feature_rows).select("session_id", "itemid", "p1").orderBy("session_id", "itemid")
        assert [r.p1 for r in found.collect()] == pytest.approx([r.p1 for r in first.collect()])
    with pytest.raises(ValueError, match="rows"):
        predictions_from(path)


def test_forest_small(spark, feature_rows):
    model = M.train_intent(feature_rows, M.forest(num_trees=5, max_depth=4, max_bins=32))
    preds = score(model, feature_rows)
    assert preds.filter("p1 < 0 or p1 > 1").count() == 0


def test_large_forest_is_grown_in_parts(spark, scratch, monkeypatch):
    """No fit keeps the samples of more than ``PART_TREES`` trees, nor their nodes; the parts make one forest."""
    from pyspark.ml.classification import RandomForestClassifier
    fits = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows: fits.append(
        (self.getNumTrees(), self.getCacheNodeIds(), self.getFeatureSubsetStrategy(), self.getSeed())) or fit(self, rows))
    rows = spark.range(600).selectExpr("cast(id % 20 as double) a", "cast(id % 7 as double) b",
                                       "cast(id % 20 >= 10 as double) label")
    monkeypatch.setattr(M, "FOREST_KEPT", 600 * 23 - 1)
    model = M.train_intent(rows, M.forest(num_trees=23, max_depth=4), num_cols=["a", "b"], cat_cols=())
    assert sum(n for n, *_ in fits) == 23 and max(n for n, *_ in fits) <= M.PART_TREES and len(fits) == 3
    assert not any(kept for _, kept, *_ in fits) and {f[2] for f in fits} == {"sqrt"} and len({f[3] for f in fits}) == 3
    grown = model.stages[-1]
    assert grown.getNumTrees == len(grown.trees) == 23 and grown.numClasses == grown.numFeatures == 2
    scored = model.transform(rows)
    assert scored.filter("prediction <> label").count() == 0
    M.save(model, f"{scratch}/parts")
    again = M.load(f"{scratch}/parts").transform(rows)
    assert sorted(map(str, again.select("probability").collect())) == sorted(map(str, scored.select("probability").collect()))
    fits.clear()
    monkeypatch.setattr(M, "FOREST_KEPT", 600 * 23)
    M.train_intent(rows, M.forest(num_trees=23, max_depth=4), num_cols=["a", "b"], cat_cols=())
    assert fits == [(23, True, "auto", 42)]


def test_forest_partitions_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """The feature table's few bytes a row make one file; the fit's partitions go by what a row costs."""
    from pyspark.ml.classification import RandomForestClassifier
    seen = []
    fit = RandomForestClassifier._fit

    def watched(self, rows):
        seen.append([r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()])
        return fit(self, rows)
    monkeypatch.setattr(RandomForestClassifier, "_fit", watched)
    monkeypatch.setattr(M, "FOREST_NUMBERS", 1000 * (2 * 20 + 1), raising=False)
    for n in (900, 6000):
        rows = spark.range(n).coalesce(1).select((F.col("id") % 7).cast("double").alias("x"),
                                                 (F.col("id") % 7 > 3).cast("int").alias("label"))
        model = M.train_intent(rows, M.forest(num_trees=20, max_depth=3), num_cols=["x"], cat_cols=())
        assert score(model, rows).filter("prediction <> label").count() == 0
    assert [(len(s), sum(s)) for s in seen] == [(1, 900), (6, 6000)] and max(seen[1]) <= 1100


def test_auroc_by_hand(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rows = [(0.9, 1.0), (0.8, 1.0), (0.7, 0.0), (0.6, 1.0), (0.2, 0.0), (0.1, 0.0)]
    df = spark.createDataFrame(rows, "p1 double, label double")
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="p1").evaluate(df)
    # positive-negative pairs ranked right: 8 of 9
    assert auc == pytest.approx(8 / 9)


def test_generic_multiclass_and_scoring_without_target(spark):
    rows = [(float(i % 7), ["a", "b", "c"][i % 3], ["x", "y", "z"][(i // 2) % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "f double, g string, target string")
    m = M.train_generic(df, "target", model_type="lr")
    assert m.n_classes == 3 and set(m.metrics) == {"accuracy", "f1"}
    unlabeled = df.drop("target").withColumn("g", F.when(F.col("f") == 0, F.lit("unseen")).otherwise(F.col("g")))
    scored = score(m.scorer, unlabeled)
    assert scored.count() == 300 and scored.filter("p_max is null").count() == 0


def test_generic_binary_p1_class(spark):
    rows = [(float(i), "1" if i % 5 else "0") for i in range(200)] + [(1.0, None)]
    df = spark.createDataFrame(rows, "f double, target string")
    m = M.train_generic(df, "target", model_type="rf", rf_params=dict(num_trees=3, max_depth=3, max_bins=16))
    assert m.labels == ["1", "0"] and m.p1_class == "0"   # index 1 is the rarer class
    assert set(m.metrics) == {"auroc", "auprc"}


@pytest.mark.parametrize("encoder", ["dictionary", "index", "hash"])
def test_generic_takes_a_column_of_many_values(spark, encoder):
    df = spark.createDataFrame([(f"id{i}", float(i), i % 2) for i in range(300)], "s string, x double, target int")
    m = M.train_generic(df, "target", num_cols=["x"], cat_cols=["s"], model_type="lr", encoder=encoder)
    assert 0 < m.test_preds.count() < 300 and m.test_preds.filter("p1 is null").count() == 0
    learned = [st for st in m.scorer.stages if hasattr(st, "labelsArray")]
    assert bool(learned) == (encoder == "index")        # hashing learns no list of values
    unseen = score(m.scorer, df.withColumn("s", F.lit("unseen")))
    assert unseen.filter("p1 is null").count() == 0
    with pytest.raises(ValueError, match="encoder"):
        M.train_generic(df, "target", cat_cols=["s"], encoder="other")


def test_generic_no_feature_raises(spark):
    df = spark.createDataFrame([("a", "x")], "s string, target string")
    with pytest.raises(ValueError):
        M.train_generic(df, "target", num_cols=[], cat_cols=[])


def test_read_any_and_validate(spark, scratch):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "i int, s string, d double")
    pq = os.path.join(scratch, "t.parquet")
    df.write.parquet(pq)
    csv_dir = os.path.join(scratch, "t.csv")
    df.write.option("header", True).csv(csv_dir)
    assert read_any(spark, pq).count() == 2
    assert read_any(spark, "  " + csv_dir + "  ").count() == 2   # ".csv" wins over "is a directory"
    with pytest.raises(ValueError):
        read_any(spark, "   ")
    ok, _ = validate(spark, pq)
    bad, msg = validate(spark, os.path.join(scratch, "missing.csv"))
    assert ok and not bad and "missing.csv" in msg
    assert read_any(spark, csv_dir, schema="i int, s string, d double").dtypes == df.dtypes
    os.rename(pq, os.path.join(scratch, "plain"))
    assert read_any(spark, os.path.join(scratch, "plain")).count() == 2          # a folder is Parquet
    with open(os.path.join(scratch, "broken.parquet"), "w") as f:
        f.write("i,s\n1,a\n")
    with pytest.raises(Exception):                                               # never read as CSV instead
        read_any(spark, os.path.join(scratch, "broken.parquet")).count()


def test_explore_surface(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None), (3, None, 4.5)], "i int, s string, d double")
    assert explore.numeric_columns(df, exclude=["i"]) == ["d"] and explore.string_columns(df) == ["s"]
    summ = {r.column: r for r in explore.numeric_summary(df).collect()}
    assert summ["i"]["count"] == 3 and summ["i"]["mean"] == 2.0 and summ["d"]["max"] == 4.5
    none = explore.numeric_summary(df.select("s"))
    assert none.columns == explore.numeric_summary(df).columns and none.count() == 0
    assert "|-- s: string" in explore.schema_tree(df)
    explore.register(df, "dataset")
    assert explore.head(explore.run_sql(spark, explore.default_sql()), 2).count() == 2
    explore.run_sql(spark, "CREATE OR REPLACE TEMP VIEW small AS SELECT i FROM dataset WHERE i > 1")
    assert explore.run_sql(spark, "SELECT * FROM small").count() == 2
    assert explore.class_count(df, "s").first()["n_classes"] == 2
    many = spark.range(1500).select(F.col("id"))
    explore.register(many, "many")
    assert explore.run_sql(spark, "SELECT id, count(*) AS n FROM many GROUP BY id").count() == 1500
    assert explore.run_sql(spark, "SELECT * FROM many", cap=10).count() == 10


def test_score_view_and_sinks(spark, feature_rows, scratch):
    model = M.train_intent(feature_rows, M.logistic())
    feature_rows.createOrReplaceTempView("features_view")
    preds = score_view(spark, model, "features_view")
    out = os.path.join(scratch, "preds_csv")
    sinks.export_csv(preds, out, limit=100)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 100 and "probability" in back.columns
    from cartwise.operators.scoring import top_k
    tk = os.path.join(scratch, "top")
    sinks.write_topk(top_k(preds, 5), tk)
    assert spark.read.parquet(tk).count() == feature_rows.select("session_id", "itemid").count()


def test_csv_readers(spark, scratch):
    ev = os.path.join(scratch, "events.csv")
    with open(ev, "w") as f:
        f.write("timestamp,visitorid,event,itemid,transactionid\n1433221332117,257597,view,355908,\n"
                "1433224214164,992329,transaction,248676,4000\n")
    pr = [os.path.join(scratch, f"p{i}.csv") for i in (1, 2)]
    for i, p in enumerate(pr):
        with open(p, "w") as f:
            f.write(f"timestamp,itemid,property,value\n{1435460400000 + i},460429,categoryid,{1338 + i}\n")
    assert read_events(spark, ev).count() == 2
    assert read_item_properties(spark, pr).count() == 2


def test_category_tree_reader(spark, scratch):
    from cartwise.sources import read_categories
    p = os.path.join(scratch, "category_tree.csv")
    with open(p, "w") as f:
        f.write("categoryid,parentid\n1016,213\n809,169\n213,\n")
    rows = {r.categoryid: r.parentid for r in read_categories(spark, p).collect()}
    assert rows == {1016: 213, 809: 169, 213: None}


def test_sampled_histogram_option(spark):
    from cartwise.operators.scoring import score_histogram
    df = spark.range(20000).selectExpr("id", "(id % 1000) / 1000.0 as p1")
    full = {r.bin: r["count"] for r in score_histogram(df).collect()}
    assert sum(full.values()) == 20000 and set(full.values()) == {1000}
    samp = score_histogram(df, sample_fraction=0.05, sample_key=["id"]).collect()
    assert len(samp) == 20 and 700 < sum(r["count"] for r in samp) < 1300


def test_generic_string_only_and_null_numeric(spark):
    rows = [(i, ["a", "b", "c"][i % 3], None if i % 10 == 0 else float(i % 4), "yes" if i % 3 == 0 else "no")
            for i in range(240)]
    df = spark.createDataFrame(rows, "k int, s string, x double, target string")
    only_str = M.train_generic(df.drop("x"), "target", num_cols=[], model_type="lr")
    assert only_str.num_cols == [] and only_str.cat_cols == ["s"]
    assert only_str.metrics["auroc"] > 0.9          # target is a function of s
    with_null = M.train_generic(df, "target", model_type="lr")   # null x filled with 0, no assembler error
    assert with_null.test_preds.filter("p1 is null").count() == 0


def test_generic_uses_every_feature_by_default(spark):
    cols = ", ".join([f"n{i} double" for i in range(14)] + [f"s{i} string" for i in range(6)] + ["target string"])
    rows = [tuple([float((i * 31 + j) % 7) for i in range(14)] + ["a"] * 6 + ["xy"[j % 2]]) for j in range(60)]
    m = M.train_generic(spark.createDataFrame(rows, cols), "target", model_type="lr")
    assert m.num_cols == [f"n{i}" for i in range(14)] and m.cat_cols == [f"s{i}" for i in range(6)]


def test_app_score_table_and_export(spark, feature_rows, scratch):
    from cartwise.plans.app import export, score_table
    m = M.train_generic(feature_rows, "label", num_cols=list(NUM_COLS), cat_cols=[], model_type="lr")
    scored = score_table(m, feature_rows.drop("label"), k=2)
    assert scored.score_col == "p1" and scored.topk.columns == ["session_id", "itemid", "score"]
    assert scored.topk.groupBy("session_id").count().filter("count > 2").count() == 0
    assert scored.histogram.agg(F.sum("count")).first()[0] == feature_rows.count()
    export(scored, scratch, cap=7)
    assert spark.read.option("header", True).csv(os.path.join(scratch, "predictions")).count() == 7
    assert spark.read.option("header", True).csv(os.path.join(scratch, "topk")).count() == scored.topk.count()
