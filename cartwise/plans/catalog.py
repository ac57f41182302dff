"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``
over the whole warehouse tables. Timestamps are returned as epoch
microseconds (``*_us``) so results compare exactly across engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.constants import HIST_SAMPLE_FRACTION
from cartwise.operators import explore, features, items, labels, reports, scoring, sessions, split
from cartwise.operators.clean import drop_empty_rows
from cartwise.plans.inputs import load_inputs
from cartwise.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

GAP_12H = 720


def _us(c: str, alias: str | None = None):
    return F.unix_micros(F.col(c)).alias(alias or f"{c}_us")


def _as_double(df, *cols):
    """Nullable integers as double: engines hand their nulls over alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _sessionised(spark, sf_dir, gap=30):
    return sessions.sessionize(load_inputs(spark, sf_dir).events, gap_minutes=gap)


def q_event_counts(spark, sf_dir):
    return reports.event_counts(load_inputs(spark, sf_dir).events)


def q_time_range(spark, sf_dir):
    return reports.time_range(load_inputs(spark, sf_dir).events).select(_us("min_ts"), _us("max_ts"))


def q_clean_events(spark, sf_dir):
    return load_inputs(spark, sf_dir).events.select("visitorid", "event", "itemid", _us("ts"))


def q_union_properties(spark, sf_dir):
    return load_inputs(spark, sf_dir).props.select("itemid", "property", "value", _us("ts"))


def q_latest_properties(spark, sf_dir):
    return items.latest_properties(load_inputs(spark, sf_dir).props)


def q_property_counts(spark, sf_dir):
    return items.property_counts(items.latest_properties(load_inputs(spark, sf_dir).props))


def q_items_wide(spark, sf_dir):
    return _as_double(items.items_wide(load_inputs(spark, sf_dir).props), "categoryid", "available")


def q_items_pivot(spark, sf_dir):
    latest = items.latest_properties(load_inputs(spark, sf_dir).props)
    return _as_double(items.cast_item_columns(items.pivot_properties(latest)), "categoryid", "available")


def _sessionize_query(gap):
    def q(spark, sf_dir):
        s = _sessionised(spark, sf_dir, gap)
        return s.select("visitorid", "session_seq", "session_id", "itemid", "event", _us("ts"))
    return q


def q_session_features(spark, sf_dir, gap=30):
    s = _sessionised(spark, sf_dir, gap)
    return sessions.session_features(s).select(
        "session_id", "visitorid", "session_seq", _us("session_start"), _us("session_end"),
        "views", "adds", "txns", "unique_items", "distinct_products", "duration_min", "session_hour")


def q_session_features_12h(spark, sf_dir):
    return q_session_features(spark, sf_dir, GAP_12H)


def q_enriched_events(spark, sf_dir):
    inp = load_inputs(spark, sf_dir)
    s = sessions.sessionize(inp.events)
    return _as_double(features.enrich_events(s, inp.items), "categoryid", "available").select(
        "session_id", "itemid", "event", _us("ts"), "categoryid", "available", "price")


def q_purchased_pairs(spark, sf_dir):
    return labels.purchased_pairs(_sessionised(spark, sf_dir, GAP_12H))


def q_labeled_candidates(spark, sf_dir):
    return labels.label_candidates(_sessionised(spark, sf_dir, GAP_12H)).drop("session_seq")


def q_label_balance(spark, sf_dir):
    return reports.label_balance(labels.label_candidates(_sessionised(spark, sf_dir, GAP_12H)))


def q_user_features(spark, sf_dir):
    return features.user_features(load_inputs(spark, sf_dir).events)


def q_item_features(spark, sf_dir):
    return features.item_features(load_inputs(spark, sf_dir).events)


def _xy(spark, sf_dir, gap=GAP_12H, cut_lineage=False):
    from cartwise.plans.intent import build_training_frame
    inp = load_inputs(spark, sf_dir)
    return build_training_frame(inp.events, inp.items, gap_minutes=gap, cut_lineage=cut_lineage)


TRAINING_COLS = ["session_id", "visitorid", "itemid", "label", "views", "adds", "unique_items",
                 "distinct_products", "session_hour", "duration_min", "u_events", "u_views",
                 "u_adds", "u_txn", "i_views", "i_adds", "i_txn", "categoryid", "session_start_ts"]


def q_training_frame(spark, sf_dir):
    return _as_double(_xy(spark, sf_dir), "categoryid").select(*TRAINING_COLS)


def q_temporal_split(spark, sf_dir):
    xy = _xy(spark, sf_dir, cut_lineage=True)   # the exact cut-off takes a few passes
    cutoff = split.temporal_cutoff(xy, relative_error=0.0)
    return split.split_flag(xy, cutoff).select("session_id", "itemid", "session_start_ts", "is_test")


def q_session_intent(spark, sf_dir):
    return labels.session_intent(sessions.session_counts(_sessionised(spark, sf_dir, GAP_12H)))


def q_purchase_funnel(spark, sf_dir):
    return reports.purchase_funnel(sessions.session_counts(_sessionised(spark, sf_dir, GAP_12H)))


def q_category_conversion(spark, sf_dir):
    inp = load_inputs(spark, sf_dir)
    lab = labels.label_candidates(sessions.sessionize(inp.events, gap_minutes=GAP_12H))
    return _as_double(reports.category_conversion(lab, inp.items), "categoryid")


def q_activity_by_hour(spark, sf_dir):
    return reports.activity_by_hour(load_inputs(spark, sf_dir).events)


def stand_in_score(df: DataFrame) -> DataFrame:
    """A deterministic score from the item id, so ranking operators can be
    checked row for row without a fitted model."""
    return df.withColumn("p1", (F.col("itemid") * F.lit(7919) % F.lit(1000)) / F.lit(1000.0))


def _scored_pairs(spark, sf_dir):
    """The labelled pairs with the stand-in score: all that ranking, confusion
    counts, metrics and histogram read."""
    pairs = labels.label_candidates(_sessionised(spark, sf_dir, GAP_12H))
    return stand_in_score(pairs.select("session_id", "itemid", "label"))


def q_top_k_per_session(spark, sf_dir):
    return scoring.top_k(_scored_pairs(spark, sf_dir), k=5)


def q_confusion_matrix(spark, sf_dir):
    return scoring.confusion_matrix(_scored_pairs(spark, sf_dir))


def q_binary_metrics(spark, sf_dir):
    return scoring.binary_metrics(scoring.confusion_matrix(_scored_pairs(spark, sf_dir)))


def q_score_histogram(spark, sf_dir):
    return scoring.score_histogram(_scored_pairs(spark, sf_dir))


def q_score_histogram_sampled(spark, sf_dir):
    return scoring.score_histogram(_scored_pairs(spark, sf_dir), sample_fraction=HIST_SAMPLE_FRACTION) \
        .select("bin", "count")


def q_probabilities(spark, sf_dir):
    """A probability vector from the stand-in score, through the vector
    operators: p1, p_max, flattened vectors, and ``ensure_p1`` from p_buy."""
    from pyspark.ml.functions import array_to_vector
    p1 = F.col("p1")
    preds = _scored_pairs(spark, sf_dir).select(
        "session_id", "itemid", array_to_vector(F.array(1 - p1, p1)).alias("probability"))
    flat = scoring.flatten_vectors(scoring.ensure_p1(scoring.add_probabilities(preds)))
    by_rank = scoring.ensure_p1(flat.select("session_id", "itemid", "p_max", "probability", F.col("p1").alias("p_buy"))
                                .withColumnRenamed("probability", "elements"))
    return by_rank.select("session_id", "itemid", "p1", "p_max", F.get("elements", F.lit(0)).alias("first_element"),
                          "p_buy")


def q_model_metrics(spark, sf_dir):
    """AUROC, AUPRC, accuracy and F1 of the stand-in score as a prediction."""
    from cartwise.ml import model as M
    from cartwise.plans.materialize import materialize
    preds = materialize(_scored_pairs(spark, sf_dir).select(
        F.col("label").cast("double").alias("label"), "p1",
        (F.col("p1") >= 0.5).cast("double").alias("prediction")), "stand-in-predictions")
    found = M.evaluate_binary(preds, raw_col="p1") | M.evaluate_multiclass(preds, "label")
    return spark.range(1).select(*[F.round(F.lit(v), 9).alias(k) for k, v in found.items()])


def q_numeric_summary(spark, sf_dir):
    s = explore.numeric_summary(table(spark, sf_dir, "orders"))
    # engines sum doubles in different orders: compare at 6 decimals
    return s.select("column", "count", F.round("mean", 6).alias("mean"),
                    F.round("stddev", 6).alias("stddev"), "min", "max")


def q_class_count(spark, sf_dir):
    return explore.class_count(table(spark, sf_dir, "orders"), "o_orderstatus")


def q_drop_empty_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels")
    return drop_empty_rows(docs.join(lab, "doc_id", "left").select("quality", "toxic"))


def q_sql_view(spark, sf_dir):
    explore.register(table(spark, sf_dir, "orders"), "dataset")
    explore.run_sql(spark, "CREATE OR REPLACE TEMP VIEW open_orders AS "
                           "SELECT * FROM dataset WHERE o_orderstatus = 'O'")
    return explore.run_sql(spark, "SELECT o_orderpriority, count(*) AS n_orders, "
                                  "max(o_totalprice) AS max_price FROM open_orders "
                                  "GROUP BY o_orderpriority")


def q_preview(spark, sf_dir):
    """Default query, preview and a capped query over the registered view, the
    schema tree's columns, and columns by type: how much each shows."""
    orders = table(spark, sf_dir, "orders")
    view = explore.register(orders, "preview_table")
    first = explore.run_sql(spark, explore.default_sql(view))
    capped = explore.run_sql(spark, f"SELECT o_orderkey FROM {view}", cap=1000)
    shown = {"default": first, "head": explore.head(first, 10), "capped": capped,
             "all": explore.run_sql(spark, f"SELECT * FROM {view}")}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in shown.items()]
    columns = {"columns": explore.schema_tree(orders).count("|--"), "numeric": len(explore.numeric_columns(orders)),
               "string": len(explore.string_columns(orders))}
    listed = orders.agg(F.lit(0)).select(F.explode(F.create_map(*[
        F.lit(x) for name, n in columns.items() for x in (name, n)])).alias("what", "n"))
    out = listed.withColumn("n", F.col("n").cast("long"))
    for r in rows:
        out = out.unionByName(r)
    return out


# --- fitted models: their scores beside the optimum that SQL finds by itself ----

#: Fits go on until they stand at the optimum to this precision, so scores can be compared with any other solver's.
OPTIMUM = {"tol": 1e-12, "maxIter": 1000}
DECIMALS = 3


def _intent_inputs(spark, sf_dir):
    from cartwise.plans.intent import build_training_frame
    inp = load_inputs(spark, sf_dir)
    return inp, build_training_frame(inp.events, inp.items)


def _new_folder(spark, name):
    import uuid

    from cartwise.plans.materialize import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _rounded(c, alias=None):
    return F.round(c, DECIMALS).alias(alias or c)


def q_downsample_negatives(spark, sf_dir):
    _, xy = _intent_inputs(spark, sf_dir)
    train, _, _ = split.temporal_split(xy, relative_error=0.0)
    bal, _ = split.downsample_negatives(train)
    return bal.select("session_id", "itemid", "label")


def q_random_split(spark, sf_dir):
    return split.random_split_flag(table(spark, sf_dir, "orders"), key_cols=["o_orderkey"]) \
        .select("o_orderkey", "o_orderstatus", "is_test")


def _scored_run(spark, sf_dir, classifier=None, name="lr", out_dir=None):
    from cartwise.ml.model import logistic
    from cartwise.plans.intent import run_intent
    inp, xy = _intent_inputs(spark, sf_dir)
    return run_intent(inp.events, inp.items, classifier=classifier or logistic(**OPTIMUM), xy=xy, name=name,
                      relative_error=0.0, out_dir=out_dir)


def q_score_logistic(spark, sf_dir):
    """The ranked items of the test slice with their scores."""
    return _scored_run(spark, sf_dir).topk.select("session_id", "itemid", _rounded("p_buy"))


def q_score_forest(spark, sf_dir):
    """From the top-K table that the job publishes: per session how many items
    were ranked, and whether each has the score that the forest gave it."""
    from cartwise.ml.model import forest
    from cartwise.sources import sinks
    folder = _new_folder(spark, "forest")
    run = _scored_run(spark, sf_dir, forest(), "rf", out_dir=folder)
    top = sinks.read_published(spark, f"{folder}/purchase_intent_top5_rf")
    p = F.col("p_buy")
    return top.join(run.preds.select("session_id", "itemid", "p1"), ["session_id", "itemid"]).groupBy("session_id").agg(
        F.count("*").alias("n_ranked"), F.bool_and((p == F.col("p1")) & p.between(0.0, 1.0)).alias("p_in_range"))


def q_score_saved_model(spark, sf_dir):
    """The job publishes its top-K table and saves its pipeline; the test slice
    is scored again with the saved pipeline and set beside the table."""
    from cartwise.ml.score import predictions_from
    from cartwise.sources import sinks
    folder = _new_folder(spark, "saved-model")
    run = _scored_run(spark, sf_dir, out_dir=folder)
    test = run.xy.filter(F.col("session_start_ts") > run.cutoff)
    again = predictions_from(f"{folder}/models/lr_pipeline", test)
    written = sinks.read_published(spark, f"{folder}/purchase_intent_top5_lr")
    return scoring.top_k(again).join(written.withColumnRenamed("p_buy", "p_written"), ["session_id", "itemid"], "full") \
        .select("session_id", "itemid", _rounded("p_buy"), _rounded("p_written"))


def q_fitted_metrics(spark, sf_dir):
    """Metrics and confusion counts of the fitted logistic regression on the test slice."""
    run = _scored_run(spark, sf_dir)
    cells = {f"n{r['label']}{r['pred']}": r["count"] for r in run.confusion.collect()}
    return spark.range(1).select(
        *[F.round(F.lit(run.metrics[k]), 6).alias(k) for k in ("auroc", "auprc", "auprc_p1")],
        *[F.lit(cells.get(k, 0)).cast("long").alias(k) for k in ("n00", "n01", "n10", "n11")])


def _balanced(spark, sf_dir):
    from cartwise.plans.materialize import materialize
    _, xy = _intent_inputs(spark, sf_dir)
    train, _, _ = split.temporal_split(xy, relative_error=0.0)
    return materialize(split.downsample_negatives(train)[0], "balanced")


def q_feature_vector(spark, sf_dir):
    """The training rows' feature vectors as the classifiers see them, entry by entry."""
    from cartwise.ml import model as M
    from cartwise.ml.inspect import feature_entries
    rows = _balanced(spark, sf_dir)
    entries = feature_entries(M.train_intent(rows), rows, ["session_id", "itemid"])
    return entries.select("session_id", "itemid", "feature", F.round("value", 6).alias("value"))


def q_logistic_gradient(spark, sf_dir):
    """Per feature, whether the likelihood's gradient vanishes at the fitted coefficients."""
    from cartwise.ml import model as M
    from cartwise.ml.inspect import logistic_gradient
    rows = _balanced(spark, sf_dir)
    found = logistic_gradient(M.train_intent(rows, M.logistic(**OPTIMUM)), rows)
    return found.select("feature", (F.abs("gradient") < 1e-4).alias("stationary"))


def _class_names(model, preds):
    from cartwise.ml.dictionary import few
    names = model.classes.select(F.col("idx").cast("double").alias("prediction"), F.col("value").alias("predicted"))
    return preds.join(few(names, model.n_classes), "prediction")


def q_train_multiclass(spark, sf_dir):
    from cartwise.ml.model import train_generic
    m = train_generic(table(spark, sf_dir, "orders"), "o_orderstatus",
                      num_cols=["o_totalprice", "o_custkey"], cat_cols=["o_orderpriority"],
                      model_type="lr", split_cols=["o_orderkey"], lr_params=OPTIMUM)
    return _class_names(m, m.test_preds).select("o_orderkey", "o_orderstatus", "predicted", _rounded("p_max"))


def q_train_binary(spark, sf_dir):
    from cartwise.ml.model import train_generic
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    data = table(spark, sf_dir, "labels").join(docs, "doc_id", "inner")
    m = train_generic(data, "quality", num_cols=["n_chars", "toxic"], cat_cols=["lang", "source"],
                      model_type="lr", split_cols=["doc_id"], lr_params=OPTIMUM)
    return _class_names(m, m.test_preds).select("doc_id", "quality", "predicted", _rounded("p1"))


def q_forest_rule(spark, sf_dir, rf_params=None):
    """A forest on rows whose label is a rule over three columns (the fields of
    a chessboard, turned round by a third column), so that the right class of
    every test row is known."""
    from cartwise.ml.model import train_generic
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"),
        F.round(F.col("l_discount").cast("double") * 100).alias("discount"), F.round(
            F.col("l_tax").cast("double") * 100).alias("tax"))
    odd_field = (F.floor(F.col("quantity") / 10) + F.floor(F.col("discount") / 4)) % 2 == 1
    rule = odd_field != (F.col("tax") >= 5)
    m = train_generic(line.withColumn("dear", F.when(rule, "yes").otherwise("no")), "dear",
                      num_cols=["quantity", "discount", "tax"], cat_cols=[], split_cols=["l_orderkey", "l_linenumber"],
                      rf_params={"num_trees": 40, **(rf_params or {})})
    return _class_names(m, m.test_preds).select("l_orderkey", "l_linenumber", "predicted")


def q_category_index(spark, sf_dir):
    """The numbers of two columns' values, one of them with a value per row,
    learned on four fifths of the rows and applied to all."""
    from cartwise.ml.dictionary import DictionaryIndexer
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_key"))
    rows = split.random_split_flag(line, key_cols=["row_key"])
    model = DictionaryIndexer(inputCols=["l_partkey", "row_key"], outputCols=["part_idx", "key_idx"]) \
        .fit(rows.filter("is_test = 0"))
    return model.transform(rows).select("l_orderkey", "l_linenumber", "part_idx", "key_idx")


def q_app_score_view(spark, sf_dir):
    """The any-table flow on the training frame: train a generic binary
    logistic model on ``label`` with all its features, register the frame as a
    view, score the view and rank items per session by ``p1``."""
    from cartwise.constants import CAT_COLS, NUM_COLS
    from cartwise.ml.model import train_generic
    from cartwise.plans.app import score_view
    xy = _xy(spark, sf_dir, gap=30, cut_lineage=True)
    m = train_generic(xy, "label", num_cols=NUM_COLS, cat_cols=CAT_COLS, model_type="lr",
                      split_cols=["session_id", "itemid"], lr_params=OPTIMUM)
    explore.register(xy.drop("label"), "dataset")
    return score_view(spark, m, "dataset").topk.select("session_id", "itemid", _rounded("score"))


def q_session_intent_model(spark, sf_dir):
    """Session-level intent: four features, logistic regression on the 80%
    side of the split, saved, loaded, applied to every session."""
    from cartwise.ml import model as M
    from cartwise.ml.score import score, score_from_saved
    from cartwise.plans.materialize import materialize
    feats = sessions.session_features(_sessionised(spark, sf_dir))
    rows = split.random_split_flag(
        feats.select("session_id", "views", "adds", "distinct_products", "session_hour",
                     (F.col("txns") > 0).cast("int").alias("purchase_intent")), key_cols=["session_id"])
    rows = materialize(rows, "session-intent-rows")
    model = M.train_session_intent(rows.filter("is_test = 0"), **OPTIMUM)
    path = _new_folder(spark, "session-intent")
    M.save(model, path)
    first = score(model, rows).select(*rows.columns, F.col("p1").alias("p_first"))
    again = score_from_saved(path, first)
    return again.select(*rows.columns, _rounded("p1"), (F.col("p1") == F.col("p_first")).alias("reload_ok"))


def q_approx_cutoff(spark, sf_dir):
    """The time split's approximate cut-off from one sketch per day of the
    training frame, and whether its rank is within a thousandth of the rows."""
    from cartwise.constants import SPLIT_RELATIVE_ERROR
    from cartwise.plans.materialize import materialize
    xy = _xy(spark, sf_dir, cut_lineage=True)
    day = F.floor(F.col("session_start_ts") / 86400).alias("day")
    sketches = materialize(split.start_sketches(xy.select(day, "session_start_ts"), ["day"]), "start-sketches")
    found = split.rank_error(xy, split.sketched_cutoff(sketches))
    return found.select("n", "rows", (F.col("rank_error") <= SPLIT_RELATIVE_ERROR).alias("close"))


def q_exact_areas(spark, sf_dir):
    """Areas under the curves of a score with a value of its own in nearly
    every row: a hash of the row, raised with the quantity."""
    from cartwise.functions import key_hash
    from cartwise.operators.curves import areas
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.explode(F.array(F.lit(1), F.lit(2))).alias("part"))
    score = key_hash(["l_orderkey", "l_linenumber", "part"], 42) / F.lit(float(1 << 60)) + F.col("l_quantity") / 50
    label = ((F.col("l_quantity") + 10 * F.col("part")) % 3 == 0).cast("int")
    found = areas(line.select(score.alias("p1"), label.alias("label")))
    return found.select(F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"), "n_scores")


# --- the clickstream files: written by the sinks, read by the CSV sources ------

def q_csv_clean_events(spark, sf_dir):
    from cartwise.operators.clean import clean_events
    from cartwise.sources import read_events, sinks
    raw = load_inputs(spark, sf_dir).events_raw
    path = f"{_new_folder(spark, 'csv')}/events.csv"
    sinks.export_csv(raw.select(F.unix_millis("ts").alias("timestamp"), "visitorid", "event", "itemid",
                                "transactionid"), path)
    return clean_events(read_events(spark, path)).select("visitorid", "event", "itemid", _us("ts"))


def q_csv_items_wide(spark, sf_dir):
    from cartwise.sources import item_property_parts, read_item_properties, sinks
    folder = _new_folder(spark, "csv")
    paths = [f"{folder}/part{i}.csv" for i in (1, 2)]
    for part, path in zip(item_property_parts(spark, sf_dir), paths):
        sinks.export_csv(part.select("timestamp", "itemid", "property", "value"), path)
    return _as_double(items.items_wide(items.union_properties(read_item_properties(spark, paths))),
                      "categoryid", "available")


def q_csv_any_table(spark, sf_dir):
    """Nations under regions as a category tree, through the any-table reader
    and the category source."""
    from cartwise.sources import read_any, read_categories, sinks, validate
    path = f"{_new_folder(spark, 'csv')}/category_tree.csv"
    nation = table(spark, sf_dir, "nation")
    sinks.export_csv(nation.select(F.col("n_nationkey").alias("categoryid"), F.col("n_regionkey").alias("parentid")), path)
    tree = read_any(spark, path).join(read_categories(spark, path), ["categoryid", "parentid"])
    return tree.groupBy(F.col("parentid").cast("int").alias("parentid")).agg(F.count("*").alias("children")) \
        .withColumn("readable", F.lit(validate(spark, path)[0]))


def q_row_count(spark, sf_dir):
    return reports.row_count(load_inputs(spark, sf_dir).events)


def q_ingest_nulls(spark, sf_dir):
    from cartwise.operators.clean import dropped_row_count
    from cartwise.sources.tables import events_from_log
    return dropped_row_count(events_from_log(spark, sf_dir))


def q_candidates(spark, sf_dir):
    return labels.candidates(_sessionised(spark, sf_dir, GAP_12H))


QUERIES: dict[str, Query] = {
    "event_counts": q_event_counts,
    "time_range": q_time_range,
    "clean_events": q_clean_events,
    "union_properties": q_union_properties,
    "latest_properties": q_latest_properties,
    "property_counts": q_property_counts,
    "items_wide": q_items_wide,
    "items_pivot": q_items_pivot,
    "sessionize_30m": _sessionize_query(30),
    "sessionize_12h": _sessionize_query(GAP_12H),
    "session_features": q_session_features,
    "session_features_12h": q_session_features_12h,
    "enriched_events": q_enriched_events,
    "purchased_pairs": q_purchased_pairs,
    "labeled_candidates": q_labeled_candidates,
    "label_balance": q_label_balance,
    "user_features": q_user_features,
    "item_features": q_item_features,
    "training_frame": q_training_frame,
    "temporal_split": q_temporal_split,
    "session_intent": q_session_intent,
    "purchase_funnel": q_purchase_funnel,
    "category_conversion": q_category_conversion,
    "activity_by_hour": q_activity_by_hour,
    "top_k_per_session": q_top_k_per_session,
    "confusion_matrix": q_confusion_matrix,
    "binary_metrics": q_binary_metrics,
    "score_histogram": q_score_histogram,
    "numeric_summary": q_numeric_summary,
    "class_count": q_class_count,
    "drop_empty_rows": q_drop_empty_rows,
    "sql_view": q_sql_view,
    "downsample_negatives": q_downsample_negatives,
    "random_split": q_random_split,
    "score_logistic": q_score_logistic,
    "fitted_metrics": q_fitted_metrics,
    "feature_vector": q_feature_vector,
    "logistic_gradient": q_logistic_gradient,
    "category_index": q_category_index,
    "forest_rule": q_forest_rule,
    "approx_cutoff": q_approx_cutoff,
    "exact_areas": q_exact_areas,
    "score_forest": q_score_forest,
    "score_saved_model": q_score_saved_model,
    "train_multiclass": q_train_multiclass,
    "train_binary": q_train_binary,
    "app_score_view": q_app_score_view,
    "row_count": q_row_count,
    "ingest_nulls": q_ingest_nulls,
    "candidates": q_candidates,
    "score_histogram_sampled": q_score_histogram_sampled,
    "probabilities": q_probabilities,
    "preview": q_preview,
    "model_metrics": q_model_metrics,
    "session_intent_model": q_session_intent_model,
    "csv_clean_events": q_csv_clean_events,
    "csv_items_wide": q_csv_items_wide,
    "csv_any_table": q_csv_any_table,
}
