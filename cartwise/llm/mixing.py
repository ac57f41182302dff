"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of copies that the mix takes
of it. Of all rates that give each source its target number of words and none
above ``cap``, those closest to 1 in relative entropy are

    rate = min(cap, exp(lambda_source * size / mean size of the source)),

and the lambdas are the minimum of a smooth convex dual. Its gradient and
curvature are sums over documents. A rate depends on source and size alone, so
the documents are first counted per (source, size), map-side combined, and
each Newton step is one aggregate over that table; the state of all sources
is a small table that is written after each step, so nothing but the largest
remaining error reaches the driver. A step that leaves the bracket of the
root, or that does not halve the error, is replaced by a bisection.

Rounding into copies: each cell of equal documents takes the whole part of its
rate, and systematic rounding along the sizes, largest first, shares out the
fractions; what a source then lacks or has too much (less than its longest
document) is mended by a few swaps of single copies. Which documents of a cell get the further copy is decided by a hash of
their ids, so reruns agree. Sums that decide are exact decimals and do not
depend on the order of tasks.

Skew: a cell of more than ``CELL_ROWS`` documents is cut into buckets by the
hash, so the numbering of documents never meets a large group, and one source
may hold most rows. The windows over a source's cells see one row per size
that occurs (and per bucket), at most about sqrt(2 * words) rows; that over
sources one row per source.

Defined results: null texts have size 0; null is a source of its own, the
last; documents of size 0 get a rate of 1; sources without words have target
0; repeated rows and ids each count; an empty table gives an empty result;
only ``keep`` columns travel along (columns named like the results are
replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.plans.materialize import materialize

WEIGHTS = (1, 2, 3)
CAP = 3
#: Documents of one cell that are numbered together, about.
CELL_ROWS = 50_000
#: Newton ends when each source's words are this close to its target (as a share of it).
TOLERANCE = 1e-6
MAX_STEPS = 80
MEND_ROUNDS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(key, source_size, target) from (key, source_size): the weights, in the
    order of the keys and repeating, share all sizes; a target stops at
    ``cap`` times its source's size, the excess is shared by the others.

    Sources are capped in the order of limit / weight; one is capped if its
    share of what is left by then would exceed its limit."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1).cast("int"))
    limit = (F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", level)
    capped = F.col("level") * F.col("weight") > F.col("limit")
    shared = F.min(F.when(~capped, F.struct(F.col("limit") / F.col("weight"), "key", "level"))) \
        .over(Window.partitionBy())["level"]
    return ranked.select("key", "source_size", F.when(capped, F.col("limit"))
                         .otherwise(shared * F.col("weight")).alias("target"))


def _exact(x: Column) -> Column:
    """A sum whose value doesn't depend on the order of its terms."""
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def _rate(cap: float) -> Column:
    """A cell's rate under its source's lambda; a source at its limit takes all there is."""
    full = (F.col("source_size") > 0) & (F.col("target") >= F.lit(float(cap)) * F.col("source_size"))
    return F.when(full, F.lit(float(cap))) \
        .otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("unit"))))


def solve(cells: DataFrame, aims: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, source_size, target, unit, lam) by Newton steps on the dual.
    ``cells``: (key, size, n); ``aims``: (key, source_size, target)."""
    shape = cells.groupBy("key").agg(F.sum("n").alias("docs"),
                                     F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    some = (F.col("target") > 0) & (F.col("source_size") > 0)
    ratio = F.log(F.when(some, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)))
    unit = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    per_least = unit / F.coalesce("least", F.lit(1))
    # between the lambdas at which the shortest documents alone would overshoot or undershoot
    state = materialize(aims.join(shape, "key").select(
        "key", "source_size", "target", unit.alias("unit"), F.lit(0.0).alias("lam"),
        F.least(F.lit(0.0), ratio * per_least).alias("lo"),
        F.when(ratio > 0, F.log(F.lit(float(cap))) * per_least).otherwise(F.lit(0.0)).alias("hi"),
        F.lit(float("inf")).alias("error")), "mix-state")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("unit")
        tilt = F.exp(F.col("lam") * x)
        words = F.col("n") * F.col("size")
        sums = cells.join(state, "key").groupBy("key").agg(
            _exact(words * _rate(cap)).alias("taken"),
            _exact(F.when(tilt < cap, words * x * tilt).otherwise(F.lit(0.0))).alias("curve"))
        moved = state.join(sums, "key").withColumn("g", F.col("taken") - F.col("target")) \
            .withColumn("lo", F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo"))) \
            .withColumn("hi", F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi"))) \
            .withColumn("newton", F.col("lam") - F.col("g") / F.greatest(F.col("curve"), F.lit(1e-9)))
        good = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")) \
            & (F.abs("g") <= 0.5 * F.col("error"))
        near = F.abs("g") <= tolerance * F.col("target")
        state = materialize(moved.select(
            "key", "source_size", "target", "unit",
            F.when(near, F.col("lam")).when(good, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
            .alias("lam"), "lo", "hi", F.when(near, F.lit(0.0)).otherwise(F.abs("g")).alias("error")), "mix-state")
        if not state.filter("error > 0").head(1):
            break
    return state.select("key", "source_size", "target", "unit", "lam")


def _mended(cells: DataFrame) -> DataFrame:
    """Swaps that bring each source's words nearer to its target: in each
    round one document gains a copy and one loses one (or only either), of
    all pairs that leave every document at the whole part of its rate or one
    above the one whose sizes differ most nearly by what is missing. The
    partner is the neighbour in the order of sizes, so no pairs are formed."""
    for _ in range(MEND_ROUNDS):
        lack = materialize(cells.groupBy("key").agg((F.first("target") - F.sum(
            (F.col("n") * F.col("whole") + F.col("extra")) * F.col("size"))).alias("lack")), "mix-lack")
        cell = F.struct("size", "bucket")
        gains = cells.filter((F.col("whole") < F.col("cap")) & (F.col("extra") < F.col("n")) & (F.col("size") > 0)) \
            .select("key", cell.alias("cell"))
        loses = cells.filter((F.col("extra") > 0) & (F.col("size") > 0)).select("key", cell.alias("cell"))
        none = lack.select("key", F.struct(F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("bucket"))
                           .alias("cell"))
        gains = gains.unionByName(none).select("key", F.col("cell.size").cast("double").alias("at"),
                                               F.col("cell").alias("gain"), F.lit(None).alias("loss"))
        loses = loses.unionByName(none).join(lack, "key").select(
            "key", (F.col("cell.size") + F.col("lack")).alias("at"), F.lit(None).alias("gain"), F.col("cell").alias("loss"))
        along = Window.partitionBy("key").orderBy("at", F.col("loss").isNotNull(), "gain", "loss")
        near = gains.unionByName(loses).select(
            "key", "at", "loss", F.last("gain", True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("below"),
            F.last("gain", True).over(Window.partitionBy("key").orderBy(
                F.desc("at"), F.col("loss").isNotNull(), "gain", "loss")
                .rowsBetween(Window.unboundedPreceding, 0)).alias("above")).filter("loss IS NOT NULL")
        pairs = near.select("key", "at", "loss", F.explode(F.array("below", "above")).alias("gain")) \
            .filter("gain IS NOT NULL AND gain <> loss") \
            .select("key", F.struct(F.abs(F.col("gain.size") - F.col("at")).alias("error"), "gain", "loss").alias("swap"))
        best = pairs.groupBy("key").agg(F.min("swap").alias("swap")).join(lack, "key") \
            .filter(F.col("swap.error") < F.abs("lack") - 1e-6)
        moves = materialize(best.select("key", F.inline(F.array(
            F.struct("swap.gain.size", "swap.gain.bucket", F.lit(1).alias("by")),
            F.struct("swap.loss.size", "swap.loss.bucket", F.lit(-1).alias("by"))))), "mix-moves")
        if not moves.head(1):
            break
        cells = materialize(cells.join(moves, ["key", "size", "bucket"], "left").withColumn(
            "extra", F.col("extra") + F.coalesce("by", F.lit(0))).drop("by"), "mix-cells")
    return cells


def mix(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, cap: int = CAP, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: the ``keep`` columns, size, source_size, target,
    rate and copies (0 to ``cap``); the first of ``keep`` is the id."""
    results = ("size", "source_size", "target", "rate", "copies")
    carried = [c for c in keep if c not in results]
    docs = df.select(F.struct(*carried).alias("kept"), source_key(F.col(source_col)).alias("key"),
                     word_count(F.col(text_col)).alias("size"))
    docs = materialize(docs.withColumn("h", F.xxhash64(f"kept.{carried[0]}", "key", "size")), "mix-docs")
    by_size = materialize(docs.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-sizes")
    aims = materialize(targets(by_size.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")),
                               weights, cap), "mix-targets")
    state = solve(by_size, aims, cap)

    # cells of more rows than are numbered together are cut by the hash
    hot = materialize(by_size.filter(F.col("n") > cell_rows)
                      .select("key", "size", F.ceil(F.col("n") / cell_rows).alias("cuts")), "mix-hot")
    # written, so that what follows is dealt by the buckets too, not as this join may deal it
    docs = materialize(docs.join(hot, ["key", "size"], "left").withColumn(
        "bucket", F.coalesce(F.pmod("h", "cuts"), F.lit(0)).cast("long")).drop("cuts"), "mix-buckets")
    cells = docs.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")).join(state, "key") \
        .withColumn("rate", _rate(cap)).withColumn("cap", F.lit(cap)) \
        .withColumn("whole", F.floor("rate")).withColumn("part", F.col("n") * (F.col("rate") - F.col("whole")))
    along = Window.partitionBy("key").orderBy(F.desc("size"), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    up_to = F.sum("part").over(along)
    extra = F.floor(up_to + 0.5) - F.floor(up_to - F.col("part") + 0.5)
    cells = materialize(cells.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), extra)).cast("long")),
                        "mix-cells")
    cells = _mended(cells).select("key", "size", "bucket", "source_size", "target", "rate", "whole", "extra")

    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", f"kept.{carried[0]}"))
    return docs.withColumn("place", place).join(cells, ["key", "size", "bucket"]).select(
        "kept.*", "size", "source_size", "target", "rate",
        (F.col("whole") + (F.col("place") <= F.col("extra")).cast("long")).alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` as often as its copies say."""
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copy")
