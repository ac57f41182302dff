"""Train/test splits and class balancing.

* temporal split at a quantile of ``session_start_ts``: approximate
  (Greenwald-Khanna sketch, merged across tasks, the default) or exact;
* exact quantile by distributed histogram narrowing: each pass is one
  aggregate over at most ``bins`` buckets, the driver only ever sees those
  bucket counts, and a 64-bit range closes in a handful of passes;
* negative down-sampling by a key hash, so the kept rows do not depend on
  the partition layout;
* random split by a key hash for generic tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from cartwise.constants import (NEG_TO_POS_RATIO, SEED, SPLIT_QUANTILE, SPLIT_RELATIVE_ERROR,
                                TEST_RATIO)
from cartwise.functions import hash_keep


def exact_quantile(df: DataFrame, col: str, q: float, bins: int = 16384) -> int | None:
    """Exact discrete quantile of an integer column: the value at 1-based rank
    ceil(q * n) in ascending order (nulls ignored). Distributed: repeated
    bucket counts over a shrinking [lo, hi] range."""
    c = F.col(col)
    stats = df.agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    n, lo, hi = stats["n"], stats["lo"], stats["hi"]
    if not n:
        return None
    k = max(1, math.ceil(q * n))        # rank wanted, 1-based
    below = 0                           # rows with value < lo
    lo, hi = int(lo), int(hi)
    while lo < hi:
        width = (hi - lo) // bins + 1   # bucket width, so that at most `bins` buckets
        b = F.expr(f"(`{col}` - {lo}L) div {width}L")   # integral division, no double rounding
        counts = (df.filter((c >= lo) & (c <= hi))
                  .groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
                  .orderBy("b").collect())
        acc = below
        for row in counts:
            if acc + row["n"] >= k:
                lo, hi = lo + row["b"] * width, min(hi, lo + row["b"] * width + width - 1)
                below = acc
                break
            acc += row["n"]
        if width == 1:
            break
    return lo


def temporal_cutoff(xy: DataFrame, quantile: float = SPLIT_QUANTILE,
                    relative_error: float = SPLIT_RELATIVE_ERROR,
                    col: str = "session_start_ts") -> float | None:
    """Cut-off epoch second. ``relative_error > 0`` -> ``approxQuantile``;
    ``0`` -> exact (by histogram narrowing, not by collecting values)."""
    if relative_error and relative_error > 0:
        res = xy.approxQuantile(col, [quantile], relative_error)
        return res[0] if res else None
    return exact_quantile(xy, col, quantile)


SKETCH_K = 8192     # a rank is off by about 0.0007 of the rows


def start_sketches(df: DataFrame, by: Sequence[str] = (), col: str = "session_start_ts",
                   k: int = SKETCH_K) -> DataFrame:
    """(by..., n, sketch): a small mergeable quantile sketch of ``col`` per
    partition of the log (say, per day). Kept as a table, it gives cut-offs of
    any span of days without reading the log again; a new day adds its row."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(F.count(col).alias("n"),
                       F.kll_sketch_agg_bigint(F.col(col).cast("long"), k).alias("sketch"))


def sketched_cutoff(sketches: DataFrame, quantile: float = SPLIT_QUANTILE, k: int = SKETCH_K) -> DataFrame:
    """One row: n, cutoff - the quantile of all rows that the sketches cover,
    from one merge of the sketches (null without rows)."""
    merged = sketches.filter("n > 0").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    return merged.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(
        F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(quantile)))).alias("cutoff"))


def rank_error(df: DataFrame, cutoff: DataFrame, quantile: float = SPLIT_QUANTILE,
               col: str = "session_start_ts") -> DataFrame:
    """``cutoff``'s row with rank_error: how far, as a share of the rows, the
    quantile's rank lies outside the ranks that the cut-off's value takes."""
    one = df.crossJoin(F.broadcast(cutoff.select("cutoff")))     # a single row
    ranks = one.agg(F.count(F.when(F.col(col) < F.col("cutoff"), 1)).alias("below"),
                    F.count(F.when(F.col(col) <= F.col("cutoff"), 1)).alias("upto"), F.count(col).alias("rows"))
    wanted = F.ceil(F.lit(quantile) * F.col("rows"))
    off = F.greatest(F.col("below") + 1 - wanted, wanted - F.col("upto"), F.lit(0))
    return cutoff.crossJoin(ranks).select("n", "cutoff", "rows", F.when(F.col("rows") > 0, off / F.col("rows"))
                                          .alias("rank_error"))


def temporal_split(xy: DataFrame, quantile: float = SPLIT_QUANTILE,
                   relative_error: float = SPLIT_RELATIVE_ERROR,
                   col: str = "session_start_ts"):
    """``(train, test, cutoff)``: train = start <= cutoff, test = start > cutoff."""
    q = temporal_cutoff(xy, quantile, relative_error, col)
    return xy.filter(F.col(col) <= F.lit(q)), xy.filter(F.col(col) > F.lit(q)), q


def split_flag(xy: DataFrame, cutoff, col: str = "session_start_ts") -> DataFrame:
    """Mark each row train/test at a given cut-off (one pass, no filter twice)."""
    return xy.withColumn("is_test", (F.col(col) > F.lit(cutoff)).cast("int"))


def negative_fraction(pos_cnt: int, neg_cnt: int, ratio: float = NEG_TO_POS_RATIO) -> float:
    return min(1.0, (ratio * max(1, pos_cnt)) / max(1, neg_cnt))


def downsample_negatives(train: DataFrame, ratio: float = NEG_TO_POS_RATIO, seed: int = SEED,
                         key_cols=("session_id", "itemid"), label_col: str = "label"):
    """Keep every positive and about ``ratio`` x positives of the negatives.

    Returns ``(balanced, fraction)``. Counting both classes is one aggregate;
    the keep decision is a hash of the row key and the seed, so the kept rows
    are the same for any partitioning of ``train``.
    """
    cnt = train.agg(F.count(F.when(F.col(label_col) == 1, 1)).alias("pos"),
                    F.count(F.when(F.col(label_col) == 0, 1)).alias("neg")).first()
    frac = negative_fraction(cnt["pos"], cnt["neg"], ratio)
    keep = (F.col(label_col) == 1) | ((F.col(label_col) == 0) & hash_keep(list(key_cols), frac, seed))
    return train.filter(keep), frac


def random_split_flag(df: DataFrame, test_ratio: float = TEST_RATIO, seed: int = SEED,
                      key_cols: Sequence[str] | None = None) -> DataFrame:
    """``is_test`` (0/1) by a hash of the key columns (default: all columns of
    a plain type) and the seed, the same for any layout of ``df``. Rows with
    equal keys fall on the same side."""
    keys = list(key_cols or [f.name for f in df.schema if isinstance(f.dataType, AtomicType)])
    return df.withColumn("is_test", hash_keep(keys, test_ratio, seed).cast("int"))


def random_split(df: DataFrame, test_ratio: float = TEST_RATIO, seed: int = SEED,
                 key_cols: Sequence[str] | None = None):
    """``(train, test)`` by ``random_split_flag``."""
    flagged = random_split_flag(df, test_ratio, seed, key_cols)
    return tuple(flagged.filter(F.col("is_test") == t).drop("is_test") for t in (0, 1))
