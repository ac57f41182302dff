"""Batch job entry point:

    spark-submit --py-files cartwise.zip cartwise/plans/job.py --data-dir DIR --out GOLD [--models lr,rf]
    python -m cartwise.plans.job --warehouse SF_DIR --out GOLD

``--data-dir`` holds the clickstream CSV files (``events.csv``,
``item_properties_part1.csv``, ``item_properties_part2.csv``); ``--warehouse``
uses the warehouse adapters instead. Writes, under ``--out``: the top-K table
and saved pipeline per model, and ``metrics`` (one JSON row per model).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from cartwise.constants import SESSION_GAP_MINUTES, TOP_K
from cartwise.ml import model as M
from cartwise.operators.clean import clean_events
from cartwise.operators.items import items_wide, union_properties
from cartwise.plans.inputs import load_inputs
from cartwise.plans.intent import run_models
from cartwise.plans.materialize import drop_tables
from cartwise.sources.readers import read_events, read_item_properties

EVENTS_FILE = "events.csv"
PROPERTY_FILES = ("item_properties_part1.csv", "item_properties_part2.csv")


def csv_inputs(spark: SparkSession, data_dir: str):
    events = clean_events(read_events(spark, os.path.join(data_dir, EVENTS_FILE)))
    props = union_properties(read_item_properties(spark, [os.path.join(data_dir, f) for f in PROPERTY_FILES]))
    return events, items_wide(props)


def main(argv=None, spark: SparkSession | None = None) -> dict:
    ap = argparse.ArgumentParser(description="purchase-intent batch job")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--data-dir")
    src.add_argument("--warehouse")
    ap.add_argument("--out", required=True)
    ap.add_argument("--models", default="lr,rf")
    ap.add_argument("--gap-minutes", type=float, default=SESSION_GAP_MINUTES)
    ap.add_argument("--k", type=int, default=TOP_K)
    ap.add_argument("--rf-trees", type=int, default=None)
    ap.add_argument("--rf-depth", type=int, default=None)
    a = ap.parse_args(argv)

    own_session = spark is None
    spark = spark or SparkSession.builder.appName("cartwise-intent").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if a.data_dir:
        events, items = csv_inputs(spark, a.data_dir)
    else:
        inp = load_inputs(spark, a.warehouse)
        events, items = inp.events, inp.items
    rf_kw = {k: v for k, v in (("num_trees", a.rf_trees), ("max_depth", a.rf_depth)) if v}
    makers = {"lr": lambda: M.logistic(), "rf": lambda: M.forest(**rf_kw)}
    classifiers = {m: makers[m]() for m in a.models.split(",") if m}
    try:
        runs = run_models(events, items, classifiers, gap_minutes=a.gap_minutes, k=a.k, out_dir=a.out)
        metrics = {name: dict(run.metrics, cutoff=float(run.cutoff), neg_fraction=run.neg_fraction)
                   for name, run in runs.items()}
        rows = [dict(model=name, **m) for name, m in metrics.items()]
        spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").json(os.path.join(a.out, "metrics"))
    finally:
        if own_session:         # written or failed; a caller's session may hold other tables
            drop_tables(spark)
    return metrics


if __name__ == "__main__":
    main()
