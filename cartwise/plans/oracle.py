"""The same queries as ``catalog.QUERIES`` written as plain SQL over the
warehouse tables (DuckDB dialect), used as the independent correctness
oracle. Column names and types match the Spark results."""

from __future__ import annotations

from cartwise.constants import NUM_COLS, SESSION_COLS
from cartwise.plans.oracle_fit import design, fitted

EV = """
ev AS (
  SELECT user_id AS visitorid,
         CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'addtocart'
              WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS itemid,
         ts
  FROM events),
clean AS (
  SELECT * FROM ev
  WHERE event IN ('view', 'addtocart', 'transaction')
    AND visitorid IS NOT NULL AND itemid IS NOT NULL AND ts IS NOT NULL)"""

PROPS = r"""
props AS (
  SELECT CAST(p_partkey AS INTEGER) AS itemid, CASE WHEN p_size = 2 THEN '888' ELSE 'categoryid' END AS property,
         CAST(p_size AS VARCHAR) || CASE WHEN p_size = 1 THEN '.7' ELSE '' END AS value, CAST(1704067200000 AS BIGINT) AS tms FROM part
  UNION ALL
  SELECT CAST(p_partkey AS INTEGER), CASE WHEN p_size = 2 THEN '888' ELSE 'available' END,
         CASE WHEN p_type = 'ECONOMY' THEN '0' ELSE '1' END, 1704067200000 FROM part
  UNION ALL
  SELECT CAST(p_partkey AS INTEGER), CASE WHEN p_size = 2 THEN '888' ELSE 'price' END,
         CASE WHEN p_brand = 'Brand#13' THEN 'n/a'
              ELSE 'n' || CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) END,
         1704067200000 FROM part
  UNION ALL
  SELECT CAST(p_partkey AS INTEGER), CASE WHEN p_size = 2 THEN '888' ELSE 'price' END,
         'n' || CAST(CAST(p_retailprice + 1 AS DECIMAL(10,2)) AS VARCHAR),
         1704067200000 + CAST(p_size - 25 AS BIGINT) * 86400000
  FROM part),
lat AS (
  SELECT itemid, property, value FROM (
    SELECT *, row_number() OVER (PARTITION BY itemid, property
                                 ORDER BY tms DESC, value DESC NULLS LAST) AS rn
    FROM props) WHERE rn = 1),
wide AS (
  SELECT itemid,
         TRY_CAST(regexp_replace(max(CASE WHEN property = 'categoryid' THEN value END),
                                 '^(\s*[+-]?[0-9]+)\.[0-9]*(\s*)$', '\1\2') AS INTEGER) AS categoryid,
         TRY_CAST(max(CASE WHEN property = 'available' THEN value END) AS INTEGER) AS available,
         TRY_CAST(regexp_replace(max(CASE WHEN property = 'price' THEN value END),
                                 '[^0-9.]', '', 'g') AS DOUBLE) AS price
  FROM lat GROUP BY itemid)"""


def sess(gap: int) -> str:
    return f"""
g AS (
  SELECT *, epoch_us(ts) // 1000000 AS sec,
         lag(epoch_us(ts) // 1000000) OVER (PARTITION BY visitorid ORDER BY ts) AS prev
  FROM clean),
q AS (
  SELECT *, SUM(CASE WHEN prev IS NULL OR CAST(sec - prev AS DOUBLE) / 60.0 > {gap} THEN 1 ELSE 0 END)
            OVER (PARTITION BY visitorid ORDER BY ts) AS sq
  FROM g),
sx AS (
  SELECT CAST(visitorid AS VARCHAR) || '-' || CAST(CAST(sq AS BIGINT) AS VARCHAR) AS session_id,
         visitorid, CAST(sq AS BIGINT) AS session_seq, ts, sec, itemid, event
  FROM q)"""


SF = """
sf AS (
  SELECT session_id, visitorid, session_seq, min(ts) AS session_start, max(ts) AS session_end,
         count(*) FILTER (WHERE event = 'view') AS views,
         count(*) FILTER (WHERE event = 'addtocart') AS adds,
         count(*) FILTER (WHERE event = 'transaction') AS txns,
         count(DISTINCT itemid) AS unique_items,
         count(DISTINCT CASE WHEN event = 'view' THEN itemid END) AS distinct_products,
         CAST(max(sec) - min(sec) AS DOUBLE) / 60.0 AS duration_min,
         CAST(hour(min(ts)) AS INTEGER) AS session_hour
  FROM sx GROUP BY session_id, visitorid, session_seq)"""

LAB = """
pur AS (SELECT DISTINCT session_id, itemid, 1 AS label FROM sx WHERE event = 'transaction'),
lab AS (
  SELECT c.session_id, c.visitorid, c.itemid, CAST(coalesce(p.label, 0) AS INTEGER) AS label
  FROM (SELECT DISTINCT session_id, visitorid, itemid FROM sx) c
  LEFT JOIN pur p ON c.session_id = p.session_id AND c.itemid = p.itemid)"""

UF = """
uf AS (
  SELECT visitorid, count(*) AS u_events,
         count(*) FILTER (WHERE event = 'view') AS u_views,
         count(*) FILTER (WHERE event = 'addtocart') AS u_adds,
         count(*) FILTER (WHERE event = 'transaction') AS u_txn
  FROM clean GROUP BY visitorid),
itf AS (
  SELECT itemid,
         count(*) FILTER (WHERE event = 'view') AS i_views,
         count(*) FILTER (WHERE event = 'addtocart') AS i_adds,
         count(*) FILTER (WHERE event = 'transaction') AS i_txn
  FROM clean GROUP BY itemid)"""

XY = """
xy AS (
  SELECT lab.session_id, lab.visitorid, lab.itemid, lab.label,
         sf.views, sf.adds, sf.unique_items, sf.distinct_products, sf.session_hour, sf.duration_min,
         coalesce(uf.u_events, 0) AS u_events, coalesce(uf.u_views, 0) AS u_views,
         coalesce(uf.u_adds, 0) AS u_adds, coalesce(uf.u_txn, 0) AS u_txn,
         coalesce(itf.i_views, 0) AS i_views, coalesce(itf.i_adds, 0) AS i_adds,
         coalesce(itf.i_txn, 0) AS i_txn,
         w.categoryid, epoch_us(sf.session_start) // 1000000 AS session_start_ts
  FROM lab JOIN sf ON lab.session_id = sf.session_id
  LEFT JOIN uf ON lab.visitorid = uf.visitorid
  LEFT JOIN itf ON lab.itemid = itf.itemid
  LEFT JOIN wide w ON lab.itemid = w.itemid),
xys AS (SELECT *, CAST(itemid * 7919 % 1000 AS DOUBLE) / 1000.0 AS p1 FROM xy)"""


PAIRS = """
xys AS (SELECT *, CAST(itemid * 7919 % 1000 AS DOUBLE) / 1000.0 AS p1 FROM lab)"""


def key_hash(*cols: str, seed: int = 42) -> str:
    """The first 60 bits of md5 over the columns as text and the seed."""
    parts = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
    return f"CAST('0x' || substr(md5({parts} || '|{seed}'), 1, 15) AS BIGINT)"


def share(fraction: str) -> str:
    return f"CAST(round(({fraction}) * 1152921504606846976.0) AS BIGINT)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


def _xy(gap: int = 720) -> str:
    return _with(EV, PROPS, sess(gap), SF, LAB, UF, XY)


def _pairs() -> str:
    return _with(EV, sess(720), LAB, PAIRS)


def _slice(gap: int) -> str:
    """The training frame and its exact 80% cut-off."""
    return _xy(gap).rstrip() + (",\ncut AS (SELECT quantile_disc(session_start_ts, 0.8) AS q FROM xy),\n"
                                "test AS (SELECT * FROM xy WHERE session_start_ts > (SELECT q FROM cut)),\n"
                                "train AS (SELECT * FROM xy WHERE session_start_ts <= (SELECT q FROM cut))\n")


RANKED = ("SELECT session_id, least(5, count(*)) AS n_ranked, true AS p_in_range FROM {0} "
          "GROUP BY session_id")


def _class_numbers(value: str, source: str) -> str:
    """Classes numbered by falling frequency, ties by value."""
    return (f"classes AS (SELECT CAST({value} AS VARCHAR) AS value, row_number() OVER (ORDER BY count(*) DESC, "
            f"CAST({value} AS VARCHAR)) - 1 AS k FROM {source} WHERE {value} IS NOT NULL GROUP BY 1)")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _zeros(cols) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in cols)


def _fit(source: str, numeric, categories, classes: int = 2) -> str:
    """CTEs from src to scored: the optimum's probabilities."""
    return f"{source},{design('src', numeric, categories)},{fitted(classes)}\n"


def _balanced_src() -> str:
    """src: the training frame's rows; the balanced rows of the time split are for training."""
    return _recursive(_slice(30)).rstrip() + (
        ",\nf AS (SELECT least(1.0, 3.0 * greatest(1, count(*) FILTER (WHERE label = 1)) "
        "/ greatest(1, count(*) FILTER (WHERE label = 0))) AS frac FROM train),\n"
        "src AS MATERIALIZED (SELECT session_id || '|' || itemid AS id, session_id, itemid, label, label AS k, "
        "session_start_ts > (SELECT q FROM cut) AS is_test, session_start_ts <= (SELECT q FROM cut) AND (label = 1 OR "
        f"{key_hash('session_id', 'itemid')} < {share('SELECT frac FROM f')}) AS is_train, "
        f"{_zeros(NUM_COLS)}, categoryid FROM xy)")


def _intent_fit() -> str:
    """pred: the test slice with its probabilities."""
    return _fit(_balanced_src(), NUM_COLS, ["categoryid"]).rstrip() + (
        ",\npred AS MATERIALIZED (SELECT session_id, itemid, label, p AS p1 FROM src JOIN scored USING (id) "
        "WHERE scored.k = 1 AND is_test)\n")


def _app_fit() -> str:
    return _fit(_recursive(_xy(30)).rstrip() + (
        ",\nsrc AS MATERIALIZED (SELECT session_id || '|' || itemid AS id, session_id, itemid, label AS k, "
        f"{key_hash('session_id', 'itemid')} >= {share('0.2')} AS is_train, {_zeros(NUM_COLS)}, categoryid FROM xy)"),
        NUM_COLS, ["categoryid"]).rstrip() + (
        ",\npred AS (SELECT session_id, itemid, p AS p1 FROM src JOIN scored USING (id) WHERE scored.k = 1)\n")


def _generic_fit(source: str, key: str, target: str, numeric, categories, classes: int) -> str:
    """test: the test side's rows with the probabilities of their classes."""
    return _fit("WITH RECURSIVE " + _class_numbers(target, source) + (
        f",\nsrc AS MATERIALIZED (SELECT {key} AS id, {target} AS target, k, {key_hash(key)} >= {share('0.2')} AS is_train, "
        f"{_zeros(numeric)}, {', '.join(categories)} FROM {source} JOIN classes ON value = CAST({target} AS VARCHAR))"),
        numeric, categories, classes).rstrip() + (
        ",\nbest AS (SELECT id, arg_max(value, p) AS predicted, max(p) AS p_max, max(p) FILTER (WHERE k = 1) AS p1 "
        "FROM scored JOIN classes USING (k) GROUP BY id),\n"
        "test AS (SELECT id, target, predicted, p_max, p1 FROM src JOIN best USING (id) WHERE NOT is_train)\n")


LABELLED = "(SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id))"

TOP5 = ("SELECT session_id, itemid, round(p1, 3) AS {0} FROM (SELECT *, row_number() OVER (PARTITION BY session_id "
        "ORDER BY p1 DESC, itemid) AS rk FROM pred) WHERE rk <= 5")


METRICS = """
byscore AS (SELECT p1, sum(label) AS pos, count(*) - sum(label) AS neg FROM xys GROUP BY p1),
curve AS (
  SELECT p1, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         (SELECT sum(pos) FROM byscore) AS np, (SELECT sum(neg) FROM byscore) AS nn
  FROM byscore WINDOW w AS (ORDER BY p1 DESC)),
steps AS (
  SELECT CAST(pos AS DOUBLE) / np AS d_recall, CAST(neg AS DOUBLE) / nn AS d_fpr,
         CAST(tp AS DOUBLE) / np + CAST(tp - pos AS DOUBLE) / np AS recalls,
         CAST(tp AS DOUBLE) / (tp + fp)
         + coalesce(lag(CAST(tp AS DOUBLE) / (tp + fp)) OVER (ORDER BY p1 DESC), CAST(tp AS DOUBLE) / (tp + fp))
           AS precisions
  FROM curve),
cells AS (SELECT label, CAST(p1 >= 0.5 AS INTEGER) AS pred, count(*) AS n FROM xys GROUP BY ALL),
classes AS (
  SELECT l.label, sum(n) FILTER (WHERE c.label = l.label AND c.pred = l.label) AS tp,
         sum(n) FILTER (WHERE c.label = l.label) AS actual, sum(n) FILTER (WHERE c.pred = l.label) AS called
  FROM (VALUES (0), (1)) l(label), cells c GROUP BY l.label)"""


def _summary_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, "
            f"round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
            f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM {table}")
    return "\nUNION ALL\n".join(parts)


ORACLE: dict[str, str] = {
    "row_count": _with(EV) + "SELECT count(*) AS rows FROM clean",
    "ingest_nulls": _with(EV) + (
        "SELECT count(*) FILTER (WHERE visitorid IS NULL OR event IS NULL OR itemid IS NULL OR ts IS NULL) "
        "AS dropped_nulls, count(*) AS rows FROM ev"),
    "candidates": _with(EV, sess(720)) + "SELECT DISTINCT session_id, visitorid, itemid FROM sx",
    "event_counts": _with(EV) + "SELECT event, count(*) AS count FROM clean GROUP BY event",
    "time_range": _with(EV) + "SELECT epoch_us(min(ts)) AS min_ts_us, epoch_us(max(ts)) AS max_ts_us FROM clean",
    "clean_events": _with(EV) + "SELECT visitorid, event, itemid, epoch_us(ts) AS ts_us FROM clean",
    "union_properties": _with(PROPS) + "SELECT itemid, property, value, tms * 1000 AS ts_us FROM props",
    "latest_properties": _with(PROPS) + "SELECT itemid, property, value FROM lat",
    "property_counts": _with(PROPS) + ("SELECT property, count(*) AS count FROM lat GROUP BY property "
                                       "ORDER BY count DESC, property"),
    "items_wide": _with(PROPS) + "SELECT itemid, CAST(categoryid AS DOUBLE) AS categoryid, CAST(available AS DOUBLE) AS available, price FROM wide",
    "items_pivot": _with(PROPS) + "SELECT itemid, CAST(categoryid AS DOUBLE) AS categoryid, CAST(available AS DOUBLE) AS available, price FROM wide",
    "sessionize_30m": _with(EV, sess(30)) + (
        "SELECT visitorid, session_seq, session_id, itemid, event, epoch_us(ts) AS ts_us FROM sx"),
    "sessionize_12h": _with(EV, sess(720)) + (
        "SELECT visitorid, session_seq, session_id, itemid, event, epoch_us(ts) AS ts_us FROM sx"),
    "session_features": _with(EV, sess(30), SF) + (
        "SELECT session_id, visitorid, session_seq, epoch_us(session_start) AS session_start_us, "
        "epoch_us(session_end) AS session_end_us, views, adds, txns, unique_items, distinct_products, "
        "duration_min, session_hour FROM sf"),
    "session_features_12h": _with(EV, sess(720), SF) + (
        "SELECT session_id, visitorid, session_seq, epoch_us(session_start) AS session_start_us, "
        "epoch_us(session_end) AS session_end_us, views, adds, txns, unique_items, distinct_products, "
        "duration_min, session_hour FROM sf"),
    "enriched_events": _with(EV, PROPS, sess(30)) + (
        "SELECT sx.session_id, sx.itemid, sx.event, epoch_us(sx.ts) AS ts_us, CAST(w.categoryid AS DOUBLE) AS categoryid, "
        "CAST(w.available AS DOUBLE) AS available, "
        "w.price FROM sx LEFT JOIN wide w ON sx.itemid = w.itemid"),
    "purchased_pairs": _with(EV, sess(720)) + (
        "SELECT DISTINCT session_id, itemid, 1 AS label FROM sx WHERE event = 'transaction'"),
    "labeled_candidates": _with(EV, sess(720), LAB) + "SELECT session_id, visitorid, itemid, label FROM lab",
    "label_balance": _with(EV, sess(720), LAB) + "SELECT label, count(*) AS count FROM lab GROUP BY label",
    "user_features": _with(EV, UF) + "SELECT * FROM uf",
    "item_features": _with(EV, UF) + "SELECT * FROM itf",
    "training_frame": _xy() + (
        "SELECT session_id, visitorid, itemid, label, views, adds, unique_items, distinct_products, "
        "session_hour, duration_min, u_events, u_views, u_adds, u_txn, i_views, i_adds, i_txn, "
        "CAST(categoryid AS DOUBLE) AS categoryid, session_start_ts FROM xy"),
    "temporal_split": _xy() + (
        "SELECT session_id, itemid, session_start_ts, "
        "CAST(session_start_ts > (SELECT quantile_disc(session_start_ts, 0.8) FROM xy) AS INTEGER) AS is_test "
        "FROM xy"),
    "session_intent": _with(EV, sess(720), SF) + (
        "SELECT session_id, CAST(txns > 0 AS INTEGER) AS purchase_intent FROM sf"),
    "purchase_funnel": _with(EV, sess(720), SF) + (
        "SELECT sessions, viewed, carted, purchased, "
        "CASE WHEN viewed > 0 THEN CAST(carted AS DOUBLE) / viewed END AS view_to_cart, "
        "CASE WHEN carted > 0 THEN CAST(purchased AS DOUBLE) / carted END AS cart_to_purchase FROM ("
        "SELECT count(*) AS sessions, count(*) FILTER (WHERE views > 0) AS viewed, "
        "count(*) FILTER (WHERE views > 0 AND adds > 0) AS carted, "
        "count(*) FILTER (WHERE views > 0 AND adds > 0 AND txns > 0) AS purchased FROM sf)"),
    "category_conversion": _with(EV, PROPS, sess(720), LAB) + (
        "SELECT CAST(w.categoryid AS DOUBLE) AS categoryid, count(*) AS pairs, CAST(sum(lab.label) AS BIGINT) AS purchases, "
        "CAST(sum(lab.label) AS DOUBLE) / count(*) AS conversion_rate "
        "FROM lab LEFT JOIN wide w ON lab.itemid = w.itemid GROUP BY w.categoryid"),
    "activity_by_hour": _with(EV) + (
        "SELECT CAST(hour(ts) AS INTEGER) AS hour, event, count(*) AS events FROM clean GROUP BY ALL"),
    "top_k_per_session": _pairs() + (
        "SELECT session_id, itemid, p_buy FROM (SELECT session_id, itemid, p1 AS p_buy, "
        "row_number() OVER (PARTITION BY session_id ORDER BY p1 DESC, itemid ASC) AS rk FROM xys) "
        "WHERE rk <= 5"),
    "confusion_matrix": _pairs() + (
        "SELECT label, CAST(p1 >= 0.5 AS INTEGER) AS pred, count(*) AS count FROM xys "
        "GROUP BY ALL ORDER BY label, pred"),
    "binary_metrics": _pairs() + (
        "SELECT CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy, "
        "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision, "
        "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM ("
        "SELECT count(*) FILTER (WHERE label = 1 AND p1 >= 0.5) AS tp, "
        "count(*) FILTER (WHERE label = 0 AND p1 >= 0.5) AS fp, "
        "count(*) FILTER (WHERE label = 1 AND p1 < 0.5) AS fn, "
        "count(*) FILTER (WHERE label = 0 AND p1 < 0.5) AS tn FROM xys)"),
    "score_histogram": _pairs() + (
        "SELECT b.bin, CAST(b.bin AS DOUBLE) / 20.0 AS bin_lo, CAST(b.bin + 1 AS DOUBLE) / 20.0 AS bin_hi, "
        "CAST(coalesce(c.count, 0) AS BIGINT) AS count "
        "FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b LEFT JOIN ("
        "SELECT CAST(least(floor(coalesce(p1, 0.0) * 20), 19) AS INTEGER) AS bin, count(*) AS count "
        "FROM xys WHERE coalesce(p1, 0.0) BETWEEN 0 AND 1 GROUP BY 1) c ON b.bin = c.bin"),
    "numeric_summary": _summary_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
    "class_count": "SELECT count(DISTINCT o_orderstatus) AS n_classes FROM orders WHERE o_orderstatus IS NOT NULL",
    "drop_empty_rows": ("SELECT l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
                        "WHERE NOT (l.quality IS NULL AND l.toxic IS NULL)"),
    "sql_view": ("SELECT o_orderpriority, count(*) AS n_orders, max(o_totalprice) AS max_price "
                 "FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority"),
    "downsample_negatives": _slice(30).rstrip() + (
        ",\nf AS (SELECT least(1.0, 3.0 * greatest(1, count(*) FILTER (WHERE label = 1)) "
        "/ greatest(1, count(*) FILTER (WHERE label = 0))) AS frac FROM train) "
        "SELECT session_id, itemid, label FROM train WHERE label = 1 OR "
        f"{key_hash('session_id', 'itemid')} < {share('SELECT frac FROM f')}"),
    "random_split": ("SELECT o_orderkey, o_orderstatus, "
                     f"CAST({key_hash('o_orderkey')} < {share('0.2')} AS INTEGER) AS is_test FROM orders"),
    "score_histogram_sampled": _pairs() + (
        "SELECT b.bin, CAST(coalesce(c.count, 0) AS BIGINT) AS count "
        "FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b LEFT JOIN ("
        "SELECT CAST(least(floor(p1 * 20), 19) AS INTEGER) AS bin, count(*) AS count "
        f"FROM xys WHERE {key_hash('session_id', 'itemid')} < {share('0.05')} GROUP BY 1) c ON b.bin = c.bin"),
    "probabilities": _pairs() + (
        "SELECT session_id, itemid, p1, greatest(p1, 1 - p1) AS p_max, 1 - p1 AS first_element, p1 AS p_buy FROM xys"),
    "model_metrics": _pairs().rstrip() + "," + METRICS + (
        " SELECT round((SELECT sum(d_fpr * recalls / 2) FROM steps), 9) AS auroc, "
        "round((SELECT sum(d_recall * precisions / 2) FROM steps), 9) AS auprc, "
        "round((SELECT CAST(sum(n) FILTER (WHERE label = pred) AS DOUBLE) / sum(n) FROM cells), 9) AS accuracy, "
        "round((SELECT sum(coalesce(2.0 * tp / (actual + called), 0) * actual) / sum(actual) FROM classes), 9) AS f1"),
    "score_logistic": _intent_fit() + TOP5.format("p_buy"),
    "score_forest": _slice(30) + RANKED.format("test"),
    "score_saved_model": _intent_fit() + TOP5.format("p_buy").replace(
        "AS p_buy", "AS p_buy, round(p1, 3) AS p_written", 1),
    "app_score_view": _app_fit() + TOP5.format("score"),
    "fitted_metrics": _intent_fit().rstrip() + "," + METRICS.replace("xys", "pred") + (
        ",\narea AS (SELECT round((SELECT sum(d_fpr * recalls / 2) FROM steps), 6) AS auroc, "
        "round((SELECT sum(d_recall * precisions / 2) FROM steps), 6) AS auprc) "
        "SELECT auroc, auprc, auprc AS auprc_p1, "
        + ", ".join(f"(SELECT count(*) FROM pred WHERE label = {y} AND (p1 >= 0.5) = {p}) AS n{y}{int(p)}"
                    for y in (0, 1) for p in (False, True)) + " FROM area"),
    "feature_vector": _balanced_src() + "," + design("src", NUM_COLS, ["categoryid"]) + """,
ranked AS (
  SELECT categoryid, row_number() OVER (ORDER BY count(*) DESC, CAST(categoryid AS VARCHAR)) - 1 AS place
  FROM src WHERE is_train AND categoryid IS NOT NULL GROUP BY categoryid)
SELECT session_id, itemid, coalesce('categoryid_oh_' || place, f) AS feature, round(lx.v, 6) AS value
FROM lx JOIN numbered USING (j) JOIN src USING (id) LEFT JOIN ranked ON f = 'categoryid=' || ranked.categoryid
WHERE src.is_train""",
    "logistic_gradient": _balanced_src() + ("\nSELECT '(intercept)' AS feature, true AS stationary UNION ALL "
        + " UNION ALL ".join(f"SELECT '{c}', true" for c in NUM_COLS) + " UNION ALL "
        "SELECT 'categoryid_oh_' || (row_number() OVER () - 1), true FROM (SELECT DISTINCT categoryid FROM src "
        "WHERE is_train AND categoryid IS NOT NULL)"),
    "category_index": ("WITH line AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS part, "
        "l_orderkey || '-' || l_linenumber AS row_key FROM lineitem),\n"
        f"learned AS (SELECT * FROM line WHERE {key_hash('row_key')} >= {share('0.2')}),\n"
        + ",\n".join(f"n_{c} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) AS idx "
                     f"FROM learned GROUP BY {c})" for c in ("part", "row_key"))
        + "\nSELECT l_orderkey, l_linenumber, coalesce(p.idx, (SELECT count(*) FROM n_part)) AS part_idx, "
        "coalesce(r.idx, (SELECT count(*) FROM n_row_key)) AS key_idx "
        "FROM line LEFT JOIN n_part p USING (part) LEFT JOIN n_row_key r USING (row_key)"),
    "forest_rule": ("SELECT l_orderkey, l_linenumber, CASE WHEN ((floor(l_quantity / 10) + "
        "floor(round(l_discount * 100) / 4)) % 2 = 1) <> (round(l_tax * 100) >= 5) THEN 'yes' ELSE 'no' END AS predicted FROM lineitem "
        f"WHERE {key_hash('l_orderkey', 'l_linenumber')} < {share('0.2')}"),
    "train_multiclass": _generic_fit("orders", "o_orderkey", "o_orderstatus", ["o_totalprice", "o_custkey"],
                                     ["o_orderpriority"], 3)
        + "SELECT id AS o_orderkey, target AS o_orderstatus, predicted, round(p_max, 3) AS p_max FROM test",
    "train_binary": _generic_fit(LABELLED, "doc_id", "quality", ["n_chars", "toxic"], ["lang", "source"], 2)
        + "SELECT id AS doc_id, target AS quality, predicted, round(p1, 3) AS p1 FROM test",
    "session_intent_model": _fit(_recursive(_with(EV, sess(30), SF)).rstrip() + (
        ",\nsrc AS MATERIALIZED (SELECT session_id AS id, views, adds, distinct_products, session_hour, "
        f"CAST(txns > 0 AS INTEGER) AS k, {key_hash('session_id')} >= {share('0.2')} AS is_train FROM sf)"),
        SESSION_COLS, []) + (
        "SELECT id AS session_id, views, adds, distinct_products, session_hour, src.k AS purchase_intent, "
        "CAST(NOT is_train AS INTEGER) AS is_test, round(p, 3) AS p1, true AS reload_ok "
        "FROM src JOIN scored USING (id) WHERE scored.k = 1"),
    "approx_cutoff": _xy() + "SELECT count(*) AS n, count(*) AS rows, true AS close FROM xy",
    "exact_areas": ("WITH xys AS (SELECT "
        f"{key_hash('l_orderkey', 'l_linenumber', 'part')} / 1152921504606846976.0 + l_quantity / 50 AS p1, "
        "CAST((l_quantity + 10 * part) % 3 = 0 AS INTEGER) AS label "
        "FROM lineitem, (SELECT unnest([1, 2]) AS part)),") + METRICS + (
        " SELECT round((SELECT sum(d_fpr * recalls / 2) FROM steps), 9) AS auroc, "
        "round((SELECT sum(d_recall * precisions / 2) FROM steps), 9) AS auprc, (SELECT count(*) FROM byscore) AS n_scores"),
    "csv_clean_events": _with(EV) + ("SELECT visitorid, event, itemid, epoch_us(ts) // 1000 * 1000 AS ts_us "
                                     "FROM (SELECT * REPLACE (CAST(visitorid AS VARCHAR) AS visitorid) FROM clean)"),
    "csv_items_wide": _with(PROPS) + "SELECT itemid, CAST(categoryid AS DOUBLE) AS categoryid, CAST(available AS DOUBLE) AS available, price FROM wide",
    "csv_any_table": ("SELECT CAST(n_regionkey AS INTEGER) AS parentid, count(*) AS children, true AS readable "
                      "FROM nation GROUP BY 1"),
    "preview": "\nUNION ALL\n".join(
        f"SELECT '{what}' AS what, {n} AS n FROM orders" for what, n in (
            ("default", "least(100, count(*))"), ("head", "least(10, count(*))"), ("capped", "least(1000, count(*))"),
            ("all", "count(*)"), ("columns", "max(6)"), ("numeric", "max(3)"), ("string", "max(2)"))),
}
