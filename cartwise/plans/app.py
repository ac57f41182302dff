"""The any-table flow: load -> explore -> train -> score a table or view ->
histogram, top-K, exports. Every result stays a DataFrame; exports go
through Spark's writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cartwise.constants import TOP_K
from cartwise.ml.model import GenericModel
from cartwise.ml.score import score
from cartwise.operators import scoring
from cartwise.sources import sinks


@dataclass
class Scored:
    preds: DataFrame
    score_col: str | None
    histogram: DataFrame | None
    topk: DataFrame | None


def score_col_for(model: GenericModel) -> str:
    """``p1`` for two classes, ``p_max`` otherwise."""
    return "p1" if model.n_classes == 2 else "p_max"


def score_table(model: GenericModel, df: DataFrame, k: int = TOP_K,
                session_col: str = "session_id", item_col: str = "itemid",
                hist_sample: float | None = None) -> Scored:
    """Score ``df`` (target column not needed), build the score histogram and,
    when the table has session and item columns, the top-K per session in a
    column named ``score``."""
    preds = score(model.scorer, df)
    col = score_col_for(model) if "probability" in preds.columns else None
    hist = scoring.score_histogram(preds, col, sample_fraction=hist_sample) if col else None
    topk = None
    if col and {session_col, item_col} <= set(preds.columns):
        topk = scoring.top_k(preds, k, score_col=col, out_col="score",
                             session_col=session_col, item_col=item_col)
    return Scored(preds=preds, score_col=col, histogram=hist, topk=topk)


def score_view(spark: SparkSession, model: GenericModel, view: str, **kw) -> Scored:
    return score_table(model, spark.table(view), **kw)


def export(scored: Scored, out_dir: str, cap: int | None = None) -> None:
    """Top-K and predictions as CSV, all rows, written by all tasks; ``cap``
    limits the predictions where the caller wants a small download."""
    if scored.topk is not None:
        sinks.export_csv(scored.topk, f"{out_dir}/topk")
    sinks.export_csv(scored.preds, f"{out_dir}/predictions", limit=cap)
