"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its ``PIVOTS_KEPT`` nearest reference points
(pivots), nearest first. Each pivot has an inverted list of the vectors that
name it. Vectors that share at least ``MIN_SHARED`` pivots are candidates, and
candidates are verified by their cosine in double precision. Only vectors of
the same (non-null) label and length are compared.

Work is split by list: a vector enters the lists of its first
``PIVOTS_KEPT - MIN_SHARED + 1`` pivots in pivot order, which any pair that
shares enough pivots has in common, and a pair is looked at in the list of its
first shared pivot alone. A list of more than ``LIST_ROWS`` vectors is cut into
blocks and handled pair of blocks by pair of blocks, so no task holds a whole
hot list. Equal vectors are collapsed first and counted by their number. A
list reports links counted per vector and a spanning forest, never all pairs.

The pivots are taken from the vectors with the least content hashes,
``pivot_count`` of them: four times the root of the number of distinct
vectors, 16 at least and ``MAX_PIVOTS`` at most. Of those that are closer to
each other than a cosine of ``PIVOT_COSINE`` one is kept: many pivots inside
one dense group would rank at random there. They, and only they, reach the
driver and are broadcast. All vectors are indexed. The index is approximate: a link whose
two vectors share too few pivots is missed (recall is measured in the tests
and in the README); no pair below the threshold is linked.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components, and vectors with a null label, link with nothing and
are components of their own; equal vectors of a label link; null ids are
allowed (never the smallest); repeated rows count as further vectors; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.batches import map_batches
from cartwise.llm.components import connected_components
from cartwise.llm.simhash import forest_of
from cartwise.plans.materialize import materialize

THRESHOLD = 0.98
PIVOTS_KEPT = 8
MIN_SHARED = 2
MAX_PIVOTS = 4_096
PIVOT_COSINE = 0.8
LIST_ROWS = 512


def pivot_count(rows: int) -> int:
    return max(16, min(MAX_PIVOTS, math.ceil(4 * math.sqrt(rows))))


def _usable(vector, label):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & vector.isNotNull() & finite & some, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows, in double precision, of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)        # no overflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spread_out(vectors: np.ndarray, cosine: float = PIVOT_COSINE) -> np.ndarray:
    """The vectors without those that are close to an earlier one kept."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    kept = np.ones(len(units), bool)
    for i in range(len(units)):
        if kept[i]:
            kept[i + 1:] &= units[i + 1:] @ units[i] < cosine
    return vectors[kept]


def _describe(batches, pivots, kept: int):
    """Each vector with ``names``: its nearest pivots, in pivot order."""
    units = {size: _matrix(pa.array(rows.tolist(), pa.list_(pa.float64()))) for size, rows in pivots.value.items()}
    for b in batches:
        sizes = pc.list_value_length(b.column("vector")).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            part = b.filter(pa.array(sizes == size))
            near = _matrix(part.column("vector")) @ units[int(size)].T
            k = min(kept, near.shape[1])
            names = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1).astype(np.int32)
            ends = np.arange(0, k * part.num_rows + 1, k, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(names.ravel()))],
                names=[*part.schema.names, "names"])


def _cell_links(names, units, own_list, left, right, shared, threshold):
    """Links between the rows ``left`` and ``right`` of one list: counts of
    shared pivots first, then the cosine."""
    values, at = np.unique(names, return_inverse=True)
    at = at.reshape(names.shape)
    marks = np.zeros((len(names), len(values)), np.float32)
    np.put_along_axis(marks, at, 1.0, axis=1)
    before = int(np.searchsorted(values, own_list))
    need = min(shared, names.shape[1])
    for s in range(0, len(left), 512):
        rows = left[s:s + 512]
        candidate = (marks[rows] @ marks[right].T >= need) \
            & (marks[rows][:, :before] @ marks[right][:, :before].T == 0)
        i, j = np.nonzero(candidate)
        i, j = rows[i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        for t in range(0, len(i), 1 << 15):
            a, b = i[t:t + (1 << 15)], j[t:t + (1 << 15)]
            linked = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
            yield a[linked], b[linked]


def _verify(batches, shared: int, threshold: float):
    """Per cell: (a, b, links): forest edges a-b with links null, and per
    vector a its number of links found here with b null."""
    def cell(t: pa.RecordBatch) -> pa.RecordBatch:
        node, copies = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies"))
        units, block = _matrix(t.column("vector")), t.column("block").to_numpy(zero_copy_only=False)
        k = len(t.column("names")[0])
        names = t.column("names").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        links, pairs = np.zeros(len(node), np.int64), []
        for i, j in _cell_links(names, units, t.column("list")[0].as_py(), left, right, shared, threshold):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            items, roots = forest_of(len(node), [(i, j)])
            pairs.append((items, roots))
        items, roots = forest_of(len(node), pairs)
        some = np.flatnonzero(links)
        a = np.concatenate([node[items], node[some]])
        b = pa.concat_arrays([pa.array(node[roots]), pa.nulls(len(some), pa.int64())])
        n = pa.concat_arrays([pa.nulls(len(items), pa.int64()), pa.array(links[some])])
        return pa.RecordBatch.from_arrays([pa.array(a), b, n], names=["a", "b", "links"])

    held: list[pa.RecordBatch] = []         # the batches of the cell that is still open
    key = None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "size", "list", "low", "high"))))
        cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if keys[s] != key and held:
                yield cell(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            key = keys[s]
            held.append(b.slice(s, e - s))
    if held:
        yield cell(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD, kept: int = PIVOTS_KEPT,
                    shared: int = MIN_SHARED, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per input row: the id column, ``n_links`` (other vectors linked
    directly) and ``component_id`` (the smallest id reachable by links)."""
    vector, label = F.col(vector_col), F.col(label_col)
    # floats travel as they are; the cosine is computed in double precision
    floats = df.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if floats else "array<double>"
    vector = vector if floats else vector.cast(kind)
    rows = df.select(F.col(id_col).alias("id"), label.cast("string").alias("label"),
                     vector.alias("vector"), _usable(vector, label).alias("usable")) \
        .withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "vector")))
    ids = materialize(rows.select("id", "node"), "vector-ids")
    distinct = materialize(rows.filter("usable").groupBy("node", "label", "vector")
                           .agg(F.count("*").alias("copies"), F.min("id").alias("first_id")), "distinct-vectors")
    sizes = {r["size"]: r["n"] for r in distinct.groupBy(F.size("vector").alias("size"))
             .agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for size, n in sizes.items():
        least = distinct.filter(F.size("vector") == size).orderBy(F.xxhash64("node"), "node") \
            .limit(pivot_count(n)).select("vector").collect()
        pivots[size] = spread_out(np.array([r["vector"] for r in least]))
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(pivots)
    # written, so that the distances to the pivots are computed once
    described = materialize(map_batches(
        distinct.select("label", "node", "copies", "vector"), partial(_describe, pivots=held, kept=kept),
        f"label string, node long, copies long, vector {kind}, names array<int>"), "pivot-names")
    enter = F.greatest(F.size("names") - (shared - 1), F.lit(1))
    entered = described.select("label", F.size("vector").alias("size"), "node", "copies", "names", "vector",
                               F.explode(F.slice("names", F.lit(1), enter)).alias("list"))
    place = ["label", "size", "list"]
    long_lists = entered.groupBy(*place).count().filter(F.col("count") > 1) \
        .select(*place, F.ceil(F.col("count") / list_rows).cast("int").alias("blocks"))
    long_lists = materialize(long_lists, "pivot-lists")
    # lists of one vector have no pair; the others are cut into blocks
    cells = (entered.join(long_lists, place)
             .withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    cell = [*place, "low", "high"]
    dealt = cells.select(*cell, "block", "node", "copies", "names", "vector") \
        .repartition(*cell).sortWithinPartitions(*cell)
    found = materialize(map_batches(dealt, partial(_verify, shared=shared, threshold=threshold),
                                    "a long, b long, links long"), "vector-links")
    roots = materialize(connected_components(found.filter("b IS NOT NULL").select("a", "b"), "vectors"), "roots")
    links = materialize(found.filter("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links")), "links")
    nodes = materialize(distinct.select("node", "copies", "first_id")
                        .join(roots, "node", "left").join(links, F.col("node") == F.col("a"), "left")
                        .select("node", F.coalesce("root", "node").alias("root"), "first_id",
                                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "nodes")
    least = materialize(nodes.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    named = materialize(nodes.join(least, "root").select("node", "n_links", "component_id"), "named-nodes")
    linked = ids.filter("node IS NOT NULL").join(named, "node").select("id", "n_links", "component_id")
    alone = ids.filter("node IS NULL").select("id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)
