import numpy as np
import pytest

from cartwise.llm import catalog, pivots

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    """{vec_id: (n_links, component_id)} by all pairs."""
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and len(r[1]) > 0 and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])
          and any(x != 0 for x in r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = [0] * len(rows)
    for key in {(r[2], len(r[1])) for r, o in zip(rows, ok) if o}:
        at = [i for i, r in enumerate(rows) if ok[i] and (r[2], len(r[1])) == key]
        v = np.array([rows[i][1] for i in at], dtype=np.float32).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(v @ v.T >= threshold, 1))):
            i, j = at[a], at[b]
            links[i] += 1
            links[j] += 1
            x, y = sorted((find(i), find(j)), key=lambda k: ids[k])
            parent[y] = x
    return {ids[i]: (links[i], ids[find(i)]) for i in range(len(rows))}


@pytest.mark.parametrize("list_rows", [512, 16])
def test_clusters_with_long_lists(spark, list_rows):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1):
        for size in (1, 2, 40, 90):
            centre = rng.normal(size=32)
            for _ in range(size):
                rows.append((n, (centre + rng.normal(size=32) * 0.1).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(30)]
    df = spark.createDataFrame([(*r, "old") for r in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"])
           for r in pivots.near_duplicates(df, list_rows=list_rows).collect()}
    want = brute(rows)
    found, there = sum(a for a, _ in got.values()), sum(a for a, _ in want.values())
    assert there > 1000 and found >= 0.99 * there
    assert all(got[i][0] <= want[i][0] for i in want)       # nothing below the threshold is linked
    assert [c for _, c in got.values()].count(0) and {i: c for i, (_, c) in got.items()} == {
        i: c for i, (_, c) in want.items()}


def test_query_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r["vec_id"]: r for r in catalog.op4_embedding_near_dedup(spark, sf).collect()}
    assert set(got) == set(want)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.99 * sum(n for n, _ in want.values())
    for i, (n, c) in want.items():
        assert got[i]["n_links"] <= n and got[i]["kept"] == (got[i]["component_id"] == i)
        assert got[i]["component_id"] >= c


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1),
            (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 2), (11, [1.0, 2.0, 0.0], 1),
            (12, [1.0, 2.0], 1), (13, [1e38, 2e38], 1), (14, [-1.0, -2.0], 1), (15, [1.0, 2.0], None)]
    df = spark.createDataFrame([(*r, "old") for r in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(df).collect()}
    assert got == {**{i: (0, i) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11, 14, 15)},
                   **{i: (3, 8) for i in (8, 9, 12, 13)}}
    assert pivots.near_duplicates(df.limit(0)).count() == 0
    again = pivots.near_duplicates(df.filter("vec_id in (8, 14)").unionByName(df.filter("vec_id = 8"))).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in again) == [(8, 1, 8), (8, 1, 8), (14, 0, 14)]
