import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cartwise.llm import catalog, components, simhash


def fingerprint(text):
    """Bit by bit, from the contract's words."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words, word = words + [word] if word else words, ""
        else:
            word += c
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def classes(codes, max_bits):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    codes = np.array(codes, dtype=np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= max_bits) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def clustered_codes(n_clusters, seed):
    rng = random.Random(seed)
    codes = set()
    for _ in range(n_clusters):
        base = rng.getrandbits(64)
        codes.add(base)
        for _ in range(rng.choice([0, 1, 5, 40])):
            code = base
            for _ in range(rng.randint(1, 4)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    return sorted(codes)


@pytest.mark.parametrize("max_bits,node_rows", [(2, 512), (2, 4), (1, 3)])
def test_index_finds_every_class(spark, max_bits, node_rows):
    codes = clustered_codes(60, 7)
    signed = [int(c) for c in np.array(codes, dtype=np.uint64).view(np.int64)]
    links = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "code long"), max_bits, node_rows)
    root = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    own, brute = defaultdict(set), defaultdict(set)
    for code, cls in zip(signed, classes(codes, max_bits)):
        own[root.get(code, code)].add(code)
        brute[cls].add(code)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, brute.values()))


def test_pruned_pairs_are_all_pairs():
    codes = np.array(clustered_codes(40, 8), dtype=np.uint64)
    order = np.argsort(simhash._gray_rank(codes))
    codes = codes[order]
    got = {tuple(sorted(p)) for i, j in simhash.linked_pairs(np.zeros(len(codes), np.int64), codes, 2)
           for p in zip(i.tolist(), j.tolist())}
    brute = {(i, int(j) + i + 1) for i in range(len(codes))
             for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= 2)}
    assert got == brute


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    codes = [fingerprint(r["text"]) for r in docs]
    cls = classes(codes, 2)
    got = {r["doc_id"]: r for r in catalog.op8_simhash(spark, sf).collect()}
    for r, code, c in zip(docs, codes, cls):
        assert got[r["doc_id"]]["fingerprint"] == f"{code:016x}"
        assert got[r["doc_id"]]["component_id"] == docs[c]["doc_id"]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c d e"), (6, "a b c d e"),
            (None, "a b c d e"), (None, "alone here now"), (9, "w " * 40_000), (10, "a b c")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_text = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    signed = {t: int(np.array([fingerprint(t)], np.uint64).view(np.int64)[0]) for _, t in rows}
    assert by_text[(2, 0)] == by_text[(3, 0)] == 1
    assert by_text[(5, signed["one"])] == 4
    assert by_text[(None, signed["a b c d e"])] == 6
    assert by_text[(None, signed["alone here now"])] is None
    kept = simhash.keep_one(df).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == sorted(
        [(1, ""), (4, "one"), (6, "a b c d e"), (-1, "alone here now"), (9, "w " * 40_000), (10, "a b c")])
    assert kept[0].__fields__ == df.columns
    twice = spark.createDataFrame([(1, "p q r s"), (3, "k l m n"), (3, "p q r s"), (None, "x"), (None, "y"), (None, "x")],
                                  "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(twice).collect()) == [
        (-1, "x"), (-1, "y"), (1, "p q r s"), (3, "k l m n")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1000, 1000), (2000, 1999)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1999: 1999, 2000: 1999}
    assert components.connected_components(edges.limit(0)).count() == 0
