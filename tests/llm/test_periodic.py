import hashlib
import random
import re
import zlib

import numpy as np

from cartwise.llm import catalog, periodic


def brute_runs(ws):
    """Every maximal stretch of every period, cut down to smallest periods."""
    n, found = len(ws), {}
    number = {w: k for k, w in enumerate(set(ws))}
    a = np.array([number[w] for w in ws])
    for p in range(1, n // 4 + 1):
        equal = [*(a[:-p] == a[p:]).tolist(), False]
        i = -1
        while (i := next((k for k in range(i + 1, n - p) if equal[k]), None)) is not None:
            j = equal.index(False, i)
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_row(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(ws)
    best = (None,) * 4
    if runs:
        s, length, p = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, length, p, 1000 * length // p)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return (doc_id, len(runs), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    docs = []
    for _ in range(1500):
        kind = rng.randrange(4)
        if kind == 0:
            ws = [rng.randrange(2) for _ in range(rng.randrange(80))]
        elif kind == 1:
            ws = [0]
            while len(ws) < rng.randrange(1, 300):
                p = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 40])
                ws += [rng.randrange(3) for _ in range(p)] * rng.randrange(1, 7) + ws[:rng.randrange(p + 1)]
        elif kind == 2:  # a period whose words repeat inside it
            part = ([7] * rng.randrange(1, 30) + [8, 9] * rng.randrange(6)) or [1]
            ws = part * rng.randrange(3, 7) + part[:rng.randrange(len(part))]
        else:  # edited copies of a passage
            part = [rng.randrange(50) for _ in range(rng.randrange(1, 70))]
            ws = part * 9
            ws[rng.randrange(len(ws))] = -1
        docs.append(ws[:700])
    words = np.array([w + 1 for d in docs for w in d], np.int64)
    got = [[] for _ in docs]
    for d, *run in periodic.find_runs(words, np.array([len(d) for d in docs])).tolist():
        got[d].append(tuple(run))
    for have, ws in zip(got, docs, strict=True):
        assert have == brute_runs(ws), ws


def test_fibonacci_and_thue_morse_words():
    fib, prev = [0, 1], [0]
    while len(fib) < 1500:
        fib, prev = fib + prev, fib
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    for ws in (fib, thue, [0] * 3000, [0, 1] * 1500 + [2] + [0, 1] * 700):
        got = [tuple(r[1:]) for r in periodic.find_runs(np.array(ws, np.int64), np.array([len(ws)])).tolist()]
        assert got == brute_runs(ws)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in catalog.op13_periodic_runs(spark, sf).collect()}
    assert got == {i: brute_row(i, t) for i, t in docs.items()}
    assert sum(r[1] > 0 for r in got.values()) > 50


def test_edge_rows(spark, scratch):
    long = "a b c " * 40_000
    texts = [None, "", " \t\n", "x " * 6, "x " * 5, "äö   äö   äö   äö  ", long, long, "one two"]
    rows = [(None if i == 3 else i // 2, t, "extra", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, runs int")
    got = periodic.runs_of(df).collect()
    assert periodic.runs_of(df).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    assert [r["n_words"] for r in got] == [0, 0, 0, 6, 5, 8, 120_000, 120_000, 2]
    assert [[tuple(x) for x in r["runs"]] for r in got] == [
        [], [], [], [(0, 6, 1)], [], [(0, 8, 2)], [(0, 120_000, 3)], [(0, 120_000, 3)], []]
    assert [r["collapsed"] for r in got] == ["", "", "", "x", "x x x x x", "äö  ", "a b c", "a b c", "one two"]
    assert periodic.runs_of(df.limit(0)).collect() == []
    df.write.parquet(f"{scratch}/documents.parquet")
    want = [brute_row(r["doc_id"] if r["doc_id"] is not None else "", r["text"]) for r in df.collect()
            if len(r["text"] or "") < 1000]
    have = [tuple(r) for r in catalog.op13_periodic_runs(spark, scratch).collect()]
    assert len(have) == len(rows)
    assert {x[1:] for x in want} <= {x[1:] for x in have}
