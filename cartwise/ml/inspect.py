"""Looking into fitted pipelines: feature vectors in long form, and whether a
logistic fit is the optimum. Both stay in the JVM; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: how a vector column looks as a plain value: sparse (0) or dense (1)
VECTOR = "v struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def feature_names(df: DataFrame, raw_col: str = "features_raw") -> DataFrame:
    """(slot, feature): the names that the assembler gave to the slots of its
    vector, from the column's metadata. A category's slot is named by the
    number of its value."""
    groups = df.schema[raw_col].metadata["ml_attr"]["attrs"].values()
    named = sorted((a["idx"], a["name"]) for group in groups for a in group)
    return df.sparkSession.createDataFrame(named, "slot int, feature string")


def vector_entries(df: DataFrame, vector_col: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., slot, value): one row per entry of the vectors that isn't 0.
    The vector passes through its JSON form, which keeps sparse vectors sparse
    and doubles exact."""
    v = F.from_json(F.to_json(F.struct(F.col(vector_col).alias("v"))), VECTOR)["v"]
    placed = F.struct(F.lit(0).alias("slot"), F.lit(0.0).alias("value"))
    entries = F.when(v["type"] == 0, F.zip_with(v["indices"], v["values"], lambda i, x: F.struct(
        i.alias("slot"), x.alias("value")))).otherwise(F.transform(v["values"], lambda x, i: F.struct(
            i.alias("slot"), x.alias("value"))))
    entries = F.coalesce(entries, F.array_except(F.array(placed), F.array(placed)))
    return df.select(*keep, F.inline(entries)).filter(F.col("value") != 0)


def feature_entries(model: PipelineModel, rows: DataFrame, keep: Sequence[str], vector_col: str = "features",
                    raw_col: str = "features_raw") -> DataFrame:
    """(keep..., feature, value): the assembled and scaled features of
    ``rows`` that aren't 0, by name."""
    prepared = rows
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    names = feature_names(prepared, raw_col)
    return vector_entries(prepared, vector_col, keep).join(names, "slot").select(*keep, "feature", "value")


def _signed_sum(vector: Column, weight: Column) -> tuple[Column, Column]:
    """Sums of the vectors that weigh more and less than nothing (a weight
    can't be negative)."""
    return (Summarizer.sum(vector, F.greatest(weight, F.lit(0.0))),
            Summarizer.sum(vector, F.greatest(-weight, F.lit(0.0))))


def logistic_gradient(model: PipelineModel, train: DataFrame, label_col: str = "label",
                      vector_col: str = "features", raw_col: str = "features_raw") -> DataFrame:
    """(class, feature, gradient): the mean gradient of the log-likelihood at
    the fitted coefficients, by feature (and ``(intercept)``), for every class
    but the first. All of them are 0 at the optimum and only there.

    One aggregate over the training rows, its buffers as long as the vector."""
    scored = model.transform(train)
    classes = model.stages[-1].numClasses
    probability = vector_to_array("probability")
    rows = scored.select(vector_col, *[
        (probability[k] - (F.col(label_col).cast("int") == k).cast("double")).alias(f"r{k}") for k in range(1, classes)])
    sums = []
    for k in range(1, classes):
        more, less = _signed_sum(F.col(vector_col), F.col(f"r{k}"))
        sums += [vector_to_array(more).alias(f"more{k}"), vector_to_array(less).alias(f"less{k}"),
                 F.sum(f"r{k}").alias(f"all{k}")]
    one = rows.agg(F.count("*").alias("n"), *sums)
    names = feature_names(scored, raw_col)
    found = None
    for k in range(1, classes):
        total = F.zip_with(f"more{k}", f"less{k}", lambda a, b: a - b)
        slots = one.select("n", F.posexplode(total).alias("slot", "total")).join(names, "slot") \
            .select("feature", (F.col("total") / F.col("n")).alias("gradient"))
        own = slots.unionByName(one.select(F.lit("(intercept)").alias("feature"),
                                           (F.col(f"all{k}") / F.col("n")).alias("gradient"))) \
            .select(F.lit(k).alias("class"), "feature", "gradient")
        found = own if found is None else found.unionByName(own)
    return found
