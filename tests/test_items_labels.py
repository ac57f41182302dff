import pytest
from datetime import datetime, timezone

from pyspark.sql import functions as F

from cartwise.operators import features, items, labels, sessions
from cartwise.operators.clean import clean_events, drop_empty_rows

PROPS = "timestamp long, itemid int, property string, value string"
EV = "visitorid string, event string, itemid int, ts timestamp"


def ts(h, m=0, s=0):
    return datetime(2024, 1, 1, h, m, s, tzinfo=timezone.utc)


def test_latest_value_tie_and_union(spark):
    p1 = spark.createDataFrame([(1000, 1, "price", "n10"), (1000, 1, "price", "n12"),
                                (1000, 1, "categoryid", "5")], PROPS)
    p2 = spark.createDataFrame([(500, 1, "price", "n99"), (2000, 2, "price", None)], PROPS)
    props = items.union_properties(p1, p2)
    lat = {(r.itemid, r.property): r.value for r in items.latest_properties(props).collect()}
    assert lat[(1, "price")] == "n12"          # tie on ts -> larger value
    assert lat[(1, "categoryid")] == "5"
    assert lat[(2, "price")] is None
    wide = {r.itemid: r for r in items.items_wide(props).collect()}
    assert wide[1].price == 12.0 and wide[1].categoryid == 5
    piv = {r.itemid: r for r in items.cast_item_columns(items.pivot_properties(
        items.latest_properties(props))).collect()}
    assert piv[1].price == wide[1].price and piv[2].price is None


def test_bad_numbers_become_null(spark):
    rows = [(1, 1, "price", "n/a"), (1, 2, "price", "1.2.3"), (1, 3, "price", ""),
            (1, 4, "price", "-5"), (1, 5, "categoryid", "abc"), (1, 6, "available", "1")]
    w = {r.itemid: r for r in items.items_wide(spark.createDataFrame(rows, PROPS)).collect()}
    assert w[1].price is None and w[2].price is None and w[3].price is None
    assert w[4].price == 5.0                   # the minus sign is stripped
    assert w[5].categoryid is None
    assert w[6].available == 1


def test_clean_events_epoch_ms_and_filter(spark):
    raw = spark.createDataFrame(
        [(1704067200000, "v", "view", 1, None), (1704067201000, "v", "signup", 1, None),
         (1704067202000, None, "view", 1, None)],
        "timestamp long, visitorid string, event string, itemid int, transactionid string")
    out = clean_events(raw).collect()
    assert len(out) == 1 and out[0].ts.replace(tzinfo=None) == datetime(2024, 1, 1)


def test_repeat_purchase_and_label_equivalence(spark):
    rows = [("u", "view", 1, ts(1)), ("u", "transaction", 1, ts(1, 5)), ("u", "transaction", 1, ts(1, 6)),
            ("u", "view", 2, ts(1, 7)), ("w", "addtocart", 3, ts(2))]
    s = sessions.sessionize(spark.createDataFrame(rows, EV))
    lab = sorted((r.session_id, r.itemid, r.label) for r in labels.label_candidates(s).collect())
    assert lab == [("u-1", 1, 1), ("u-1", 2, 0), ("w-1", 3, 0)]
    assert labels.purchased_pairs(s).count() == 1


def test_no_item_match_gives_null_category(spark):
    rows = [("u", "view", 1, ts(1)), ("u", "view", 99, ts(1, 1))]
    s = sessions.sessionize(spark.createDataFrame(rows, EV))
    it = items.items_wide(spark.createDataFrame([(1, 1, "categoryid", "7")], PROPS))
    xy = {r.itemid: r for r in features.training_frame(s, it).collect()}
    assert xy[1].categoryid == 7 and xy[99].categoryid is None
    assert xy[1].u_events == 2 and xy[99].i_views == 1
    e = {r.itemid: r.categoryid for r in features.enrich_events(s, it).collect()}
    assert e == {1: 7, 99: None}


def test_training_frame_invariants(spark):
    import random
    rnd = random.Random(3)
    rows = [(f"u{rnd.randint(0, 8)}", rnd.choice(["view", "addtocart", "transaction"]),
             rnd.randint(1, 15), ts(rnd.randint(0, 23), rnd.randint(0, 59), rnd.randint(0, 59)))
            for _ in range(400)]
    df = spark.createDataFrame(rows, EV)
    s = sessions.sessionize(df)
    it = items.items_wide(spark.createDataFrame([(1, i, "categoryid", str(i % 4)) for i in range(1, 16)], PROPS))
    xy = features.training_frame(s, it)
    cand = s.select("session_id", "itemid").distinct().count()
    assert xy.count() == cand
    pur = s.filter(F.col("event") == "transaction").select("session_id", "itemid").distinct().count()
    assert xy.filter("label = 1").count() == pur


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, "x")], "a int, b string")
    assert drop_empty_rows(df).count() == 2


def test_latest_value_layout_invariant(spark):
    rows = [(1000 + (i % 3), i % 40, "price", f"n{i % 7}") for i in range(400)]
    props = spark.createDataFrame(rows, PROPS)
    res = [sorted(map(tuple, items.latest_properties(props.repartition(n)).collect())) for n in (1, 4, 16)]
    assert res[0] == res[1] == res[2]


def test_counts_agree_across_levels(spark):
    import random
    rnd = random.Random(8)
    rows = [(f"u{rnd.randint(0, 6)}", rnd.choice(["view", "addtocart", "transaction"]), rnd.randint(1, 9),
             ts(rnd.randint(0, 23), rnd.randint(0, 59))) for _ in range(300)]
    s = sessions.sessionize(spark.createDataFrame(rows, EV))
    sv = sessions.session_features(s).agg(F.sum("views")).first()[0]
    uv = features.user_features(s).agg(F.sum("u_views")).first()[0]
    iv = features.item_features(s).agg(F.sum("i_views")).first()[0]
    assert sv == uv == iv == sum(r[1] == "view" for r in rows)


def test_null_category_gets_all_zero_one_hot(spark):
    from pyspark.ml import Pipeline
    from cartwise.ml.model import preprocess_stages
    df = spark.createDataFrame([(1.0, 5), (2.0, 7), (3.0, 5), (4.0, None)], "views double, categoryid int")
    model = Pipeline(stages=preprocess_stages(["views"], ["categoryid"])).fit(df)
    out = {r.views: r.categoryid_oh for r in model.transform(df).collect()}
    assert out[4.0].numNonzeros() == 0            # null -> extra bucket -> dropped last slot
    assert out[1.0].numNonzeros() == 1 and out[2.0].numNonzeros() == 1


def test_empty_frames_flow_through(spark):
    from cartwise.operators import reports, scoring, split
    from cartwise.operators.explore import numeric_summary
    empty = spark.createDataFrame([], EV)
    s = sessions.sessionize(empty)
    assert s.count() == 0 and "session_id" in s.columns
    assert sessions.session_features(s).count() == 0
    assert labels.label_candidates(s).count() == 0
    f = reports.purchase_funnel(sessions.session_counts(s)).first()
    assert f.sessions == 0 and f.view_to_cart is None
    it = items.items_wide(spark.createDataFrame([], PROPS))
    assert features.training_frame(s, it).count() == 0
    assert split.exact_quantile(spark.createDataFrame([], "x long"), "x", 0.8) is None
    h = scoring.score_histogram(spark.createDataFrame([], "p1 double"))
    assert h.count() == 20 and h.agg(F.sum("count")).first()[0] == 0
    summ = numeric_summary(spark.createDataFrame([], "a int")).first()
    assert summ["count"] == 0 and summ["mean"] is None


def test_items_without_pivot_keys_stay(spark):
    props = spark.createDataFrame([(1, 1, "categoryid", "5.7"), (1, 2, "888", "x"), (1, 3, "available", " 1 "),
                                   (1, 4, "categoryid", "-3.9"), (1, 5, "categoryid", "1.2.3")], PROPS)
    wide = {r.itemid: (r.categoryid, r.available, r.price) for r in items.items_wide(props).collect()}
    pivot = {r.itemid: (r.categoryid, r.available, r.price) for r in items.cast_item_columns(
        items.pivot_properties(items.latest_properties(props))).collect()}
    assert wide == pivot == {1: (5, None, None), 2: (None, None, None), 3: (None, 1, None), 4: (-3, None, None),
                             5: (None, None, None)}


def test_property_counts_has_no_cap(spark):
    props = spark.range(45).selectExpr("1L as timestamp", "cast(id as int) as itemid",
                                       "concat('k', id) as property", "'v' as value")
    counts = items.property_counts(items.latest_properties(props))
    assert counts.count() == 45
    assert items.property_counts(items.latest_properties(props), n=30).count() == 30


def test_missing_required_column_is_refused(spark):
    with pytest.raises(ValueError, match="itemid"):
        clean_events(spark.createDataFrame([(1, "v", "view")], "timestamp long, visitorid string, event string"))
