import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cartwise.llm import catalog, mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Sharing and resharing, source by source; keys sort null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def brute_rates(sizes, target, cap=3):
    """min(cap, exp(lambda x)) with the lambda found by plain bisection."""
    total, unit = sum(sizes), max(sum(sizes) / len(sizes), 1e-9)
    if not total or target >= cap * total:
        return [cap if total else 1.0] * len(sizes)

    def rate(lam, s):
        return min(cap, math.exp(min(lam * s / unit, 50)))
    lo, hi = -2000.0, 2000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * rate(mid, s) for s in sizes) < target else (lo, mid)
    return [rate(lo, s) for s in sizes]


def holds(rows, docs, close):
    """``rows``: (doc_id, size, source_size, target, taken, rate, copies); docs: (doc_id, text, source)."""
    text, source = {d[0]: d[1] for d in docs}, {d[0]: d[2] for d in docs}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in text.items()}
    sizes = defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    want = brute_targets(sizes)
    assert sorted(r[0] for r in rows) == sorted(text)
    taken = Counter()
    by = defaultdict(list)
    for i, n, source_size, target, got, rate, copies in rows:
        s = source[i]
        assert n == size[i] and source_size == sizes[s] and target == pytest.approx(want[s], rel=1e-9)
        assert got == copies * n and 0 <= copies <= 3 and copies in (math.floor(rate), math.floor(rate) + 1)
        taken[s] += got
        by[s].append((n, rate))
    for s, own in by.items():
        brute = brute_rates([n for n, _ in own], want[s])
        assert all(rate == pytest.approx(b, rel=1e-3, abs=1e-6) for (n, rate), b in zip(own, brute, strict=True) if n)
        assert abs(taken[s] - want[s]) <= close(own, want[s])


def test_query_equals_brute_force_and_reruns_agree(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in catalog.op12_source_mixing(spark, sf).collect()]
    holds(got, docs, lambda own, target: 0.005 * target)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        again = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r[0], r[6]) for r in got)


def test_capped_hot_and_empty_sources(spark):
    rows = [(i, "w " * (1 + i % 40), "big") for i in range(3000)]
    rows += [(3000 + i, "w " * 5, "b") for i in range(40)] + [(4000 + i, "w " * 900, "c") for i in range(3)]
    rows += [(5000, None, "empty"), (5001, " \n", "empty"), (5002, "one", None), (5003, "a b", None), (5004, "x", "Ä")]
    df = spark.createDataFrame([(*r, "no", 1) for r in rows], "doc_id long, text string, source string, size string, "
                                                              "copies int")
    for cell_rows in (50_000, 7):  # with 7, hot cells are cut into many buckets
        got = mixing.mix(df, cell_rows=cell_rows).withColumn("taken", F.col("copies") * F.col("size")) \
            .select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
        holds([tuple(r) for r in got.collect()], rows,
              lambda own, target: max(2.0, min(n for n, _ in own) + 1, 1e-5 * target))
    whole = mixing.mix(df, keep=("doc_id", "text"))
    assert whole.columns == ["doc_id", "text", "size", "source_size", "target", "rate", "copies"]
    assert mixing.repeated(whole).count() == whole.agg(F.sum("copies")).first()[0]
    assert {r["copies"] for r in whole.filter("doc_id in (5000, 5001)").collect()} == {1}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "a", "s"), (None, None, None)],
                               "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 4 and sum(r["copies"] * r["size"] for r in got) == 7
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mix(df.filter("text is null")).collect()[0]["target"] == 0


def test_targets_equal_resharing(spark):
    sizes = {"a": 10, "B": 1000, "c": 1, None: 30, "é": 0, "z": 5, "zz": 400}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = mixing.targets(df.select(mixing.source_key(F.col("source")).alias("key"), "source_size")).collect()
    want = brute_targets(sizes)
    assert {r["key"]: pytest.approx(r["target"]) for r in got} == \
        {("1" if s is None else f"0{s}"): t for s, t in want.items()}
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
