"""Near-duplicates by SimHash, searched through a Gray-ordered hierarchical
index.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64
values of the text's word shingles. Fingerprints link at ``max_bits`` or fewer
differing bits.

The index. Only distinct fingerprints are indexed. Its upper nodes hold a
masked pattern: the value of one of ``max_bits + 1`` segments of the bits. Two
fingerprints that link differ in at most ``max_bits`` bits, so they agree on a
whole segment and meet, with no difference so far, in a node of it. A node of
more than ``node_rows`` fingerprints is split again by the segments of the
remaining bits, and so on; after ``MAX_LEVEL`` levels the remaining bits alone
bound a node's size. Below a node, fingerprints are sorted by Gray rank, so
that neighbours share most bits; runs of ``LEAF`` codes, and runs of runs, are
described by the bits that all of them share. Two runs whose shared bits
already differ in more than ``max_bits`` places are pruned whole.

Each node reports not all its links but a spanning forest of them, enough for
the components. No list of fingerprints reaches the driver, and no node needs
more than its own rows in one task.

Defined results: A-Z are lower-cased, words are runs of other characters than
ASCII white space; fewer words than a shingle: the whole sequence is the one
shingle; null text or no word: fingerprint zero, linked like any other;
repeated shingles count as often as they occur; null ids are allowed (they are
never the smallest; a component of null ids alone has a null component_id);
repeated rows get equal results; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.batches import add_columns, map_batches, texts_of, worker_state
from cartwise.llm.components import connected_components
from cartwise.plans.materialize import materialize

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: A node with more fingerprints than this is split by a further segment.
NODE_ROWS = 512
MAX_LEVEL = 4
#: Codes in a leaf run, and runs in a run above it.
LEAF = 16
#: Shingle values and run pairs that are worked on at once.
SLICE = 1 << 16


# --- fingerprints ------------------------------------------------------------

def _fingerprint(text: str, shingle: int, digest) -> int:
    words = text.encode().lower().split()       # bytes: ASCII letters and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    rows = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    values = np.fromiter(map(digest, map(b" ".join, rows)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, SLICE):
        octets = values[i:i + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprint_batches(shingle: int, text_at: int):
    import xxhash

    worker_state("simhash", dict)       # lets go of another operator's tables
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([_fingerprint(t, shingle, digest) for t in texts_of(batch.column(text_at))], pa.int64())]
    return fn


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with ``fingerprint`` (the 64 bits as a signed long). One map."""
    at = df.columns.index(text_col)
    return add_columns(df, [T.StructField("fingerprint", T.LongType())],
                       partial(_fingerprint_batches, shingle, at))


# --- inside one node: Gray order, shared bits, pruning --------------------------

def _gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _runs(starts: np.ndarray, ends: np.ndarray, length: int):
    """Cuts each span [start, end) into runs of ``length``; gives the runs'
    starts and ends, and each span's first run."""
    count = -(-(ends - starts) // length)
    first = np.concatenate([[0], np.cumsum(count)])
    span = np.repeat(np.arange(len(starts)), count)
    at = starts[span] + (np.arange(first[-1]) - first[span]) * length
    return at, np.minimum(at + length, ends[span]), first


def _shared(masks: np.ndarray, values: np.ndarray, starts: np.ndarray):
    """The bits that all members of a run share, and their values."""
    all_one = np.bitwise_and.reduceat(values | ~masks, starts)
    any_one = np.bitwise_or.reduceat(values & masks, starts)
    mask = np.bitwise_and.reduceat(masks, starts) & ~(all_one ^ any_one)
    return mask, any_one & mask


def _pairs_within(first: np.ndarray, last: np.ndarray):
    """All (i, j), first <= i <= j < last, for each span, a bounded number at
    a time."""
    size = last - first
    owner = np.repeat(np.arange(len(first)), size)
    i = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    partners = last[owner] - i
    yield from _expand(i, partners, lambda k, off: (i[k], i[k] + off))


def _expand(items: np.ndarray, counts: np.ndarray, make):
    total, at = np.concatenate([[0], np.cumsum(counts)]), 0
    while at < len(items):
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, side="right")) - 1)
        own = np.arange(at, to)
        k = np.repeat(own, counts[own])
        off = np.arange(len(k)) - np.repeat(total[own] - total[at], counts[own])
        yield make(k, off)
        at = to


def _children(a, b, first_a, last_a, max_bits, mask, value):
    """Child pairs (i <= j) of run pairs that the shared bits don't prune."""
    na, nb = last_a[a] - first_a[a], last_a[b] - first_a[b]

    def make(k, off):
        i = first_a[a[k]] + off // nb[k]
        j = first_a[b[k]] + off % nb[k]
        keep = i <= j
        i, j = i[keep], j[keep]
        near = np.bitwise_count((value[i] ^ value[j]) & mask[i] & mask[j]) <= max_bits
        return i[near], j[near]
    yield from _expand(a, na * nb, make)


def linked_pairs(nodes: np.ndarray, codes: np.ndarray, max_bits: int):
    """(i, j) positions of codes of one node that link; ``nodes`` is grouped
    and ``codes`` are Gray-sorted inside each node."""
    starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    ends = np.append(starts[1:], len(nodes))
    more = ends - starts > 1
    starts, ends = starts[more], ends[more]
    if not len(starts):
        return
    full = np.full(len(codes), ~np.uint64(0))
    leaf_at, leaf_to, leaf_first = _runs(starts, ends, LEAF)
    # positions outside any run must not leak into a run's reduction
    inside = np.repeat(leaf_at, leaf_to - leaf_at) + np.arange((leaf_to - leaf_at).sum()) \
        - np.repeat(np.cumsum(leaf_to - leaf_at) - (leaf_to - leaf_at), leaf_to - leaf_at)
    packed = np.cumsum(leaf_to - leaf_at) - (leaf_to - leaf_at)
    leaf_mask, leaf_value = _shared(full[inside], codes[inside], packed)
    top_at, top_to, top_first = _runs(leaf_first[:-1], leaf_first[1:], LEAF)
    top_mask, top_value = _shared(leaf_mask, leaf_value, top_at)
    for a, b in _pairs_within(top_first[:-1], top_first[1:]):
        near = np.bitwise_count((top_value[a] ^ top_value[b]) & top_mask[a] & top_mask[b]) <= max_bits
        for c, d in _children(a[near], b[near], top_at, top_to, max_bits, leaf_mask, leaf_value):
            for i, j in _children(c, d, leaf_at, leaf_to, max_bits, full, codes):
                apart = i != j
                yield i[apart], j[apart]


def forest_of(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Local roots of ``n`` items under ``pairs``: (item, root) where they
    differ. Labels only fall, so it ends."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            ri, rj = root[i], root[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            if not len(i):
                break
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    items = np.flatnonzero(root != np.arange(n))
    return items, root[items]


def _node_links(batches, max_bits: int):
    """Links (a, b) of every node of a partition sorted by node; holds one
    batch and the node that it ends in."""
    def links(nodes, codes):
        order = np.lexsort((_gray_rank(codes), nodes))
        nodes, codes = nodes[order], codes[order]
        items, roots = forest_of(len(codes), linked_pairs(nodes, codes, max_bits))
        signed = codes.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[items]), pa.array(signed[roots])], names=["a", "b"])

    nodes, codes = np.empty(0, np.int64), np.empty(0, np.uint64)
    for b in batches:
        nodes = np.concatenate([nodes, b.column(0).to_numpy(zero_copy_only=False)])
        codes = np.concatenate([codes, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(nodes, nodes[-1]))     # the last node may go on in the next batch
        if cut:
            yield links(nodes[:cut], codes[:cut])
            nodes, codes = nodes[cut:], codes[cut:]
    if len(nodes):
        yield links(nodes, codes)


# --- the distributed upper nodes -----------------------------------------------

def _split(rows: DataFrame, segments: int) -> DataFrame:
    """Every row once per segment of its remaining bits: ``node`` grows by the
    segment's number and value, ``rest`` and ``width`` shrink by its bits."""
    low, high = F.expr("cast(width * seg div {0} as int)".format(segments)), \
        F.expr("cast(width * (seg + 1) div {0} as int)".format(segments))
    return (rows.withColumn("seg", F.explode(F.array(*[F.lit(i) for i in range(segments)])))
            .withColumn("low", low).withColumn("size", high - F.col("low"))
            .select("code",
                    F.expr("shiftleft(shiftleft(node, 2) | seg, size) | "
                           "(shiftrightunsigned(rest, low) & (shiftleft(1L, size) - 1L))").alias("node"),
                    F.expr("(rest & (shiftleft(1L, low) - 1L)) | CASE WHEN low + size >= 64 THEN 0L ELSE "
                           "shiftleft(shiftrightunsigned(rest, low + size), low) END").alias("rest"),
                    (F.col("width") - F.col("size")).alias("width")))


def near_links(codes: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """A spanning forest (a, b) of the links among the distinct longs of
    ``codes`` (column ``code``)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits: 0 to 2 (node numbers hold four levels of at most three segments)")
    if max_bits == 0:
        return codes.select(F.col("code").alias("a"), F.col("code").alias("b")).limit(0)
    rows = codes.select("code", F.lit(0).cast("long").alias("node"), F.col("code").alias("rest"),
                        F.lit(64).alias("width"))
    found = []
    for level in range(1, MAX_LEVEL + 1):
        rows = _split(rows, max_bits + 1)
        last = level == MAX_LEVEL
        ready = rows
        if not last:
            crowded = materialize(rows.groupBy("node").count().filter(F.col("count") > node_rows)
                                  .select("node"), "crowded-nodes")
            last = crowded.isEmpty()
            if not last:
                rows = materialize(rows, "index-rows")
                ready = rows.join(crowded, "node", "left_anti")
                rows = rows.join(crowded, "node", "left_semi")
        sorted_nodes = ready.select("node", "code").repartition("node").sortWithinPartitions("node")
        found.append(map_batches(sorted_nodes, partial(_node_links, max_bits=max_bits), "a long, b long"))
        if last:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# --- documents ------------------------------------------------------------------

def _groups(df: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """One row per input row: id, text_key (hash of the text), fingerprint,
    root (the component's least fingerprint) and component_id."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    rows = materialize(fingerprints(texts, shingle=shingle).select("id", "text_key", "fingerprint"), "fingerprints")
    distinct = materialize(rows.groupBy("fingerprint").agg(F.min("id").alias("first_id"))
                           .withColumnRenamed("fingerprint", "code"), "distinct-fingerprints")
    roots = materialize(connected_components(near_links(distinct.select("code"), max_bits), "simhash"), "roots")
    # only linked fingerprints: the least id of each component, by its root
    linked = materialize(roots.join(distinct, roots["node"] == distinct["code"])
                         .select("code", "root", "first_id"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    named = linked.join(least, "root").select("code", "root", "component_id")
    alone = distinct.join(linked.select("code"), "code", "left_anti") \
        .select("code", F.col("code").alias("root"), F.col("first_id").alias("component_id"))
    components = materialize(named.unionByName(alone), "fingerprint-components")
    return rows.join(components, rows["fingerprint"] == components["code"]).drop("code")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: the id column, ``fingerprint`` (long) and
    ``component_id``, the smallest id that its links reach."""
    return _groups(df, id_col, text_col, shingle, max_bits) \
        .select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: the one whose id
    is the component's. Should several rows of the group have that id, the
    one with the least hash of its text stays, then of all its columns."""
    candidates = _groups(df, id_col, text_col, shingle, max_bits) \
        .filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = candidates.groupBy("root", "id", "text_key").agg(F.count("*").alias("n")) \
        .groupBy("root").agg(F.min_by(F.struct(F.col("id").alias("kept_id"), F.col("text_key").alias("kept_key"), "n"),
                                      "text_key").alias("kept"))
    kept = materialize(kept.select("kept.*"), "kept-ids")
    same = df[id_col].eqNullSafe(F.col("kept_id")) & (F.xxhash64(df[text_col]) == F.col("kept_key"))
    once = df.join(kept.filter("n = 1"), same, "left_semi")
    again = kept.filter("n > 1")
    if again.isEmpty():
        return once
    first = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.xxhash64(*df.columns))
    rest = df.join(again, same, "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return once.unionByName(rest.select(*df.columns))
