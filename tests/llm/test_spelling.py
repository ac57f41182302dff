import random
import re
import zlib
from collections import Counter

import numpy as np

from cartwise.llm import catalog, spelling


def one_edit(word, letters):
    """All strings one edit away."""
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1:]
            for c in letters:
                yield word[:i] + c + word[i + 1:]


def brute_variants(counts):
    """(word, form, root, n, n_near, form_n) from {word: n}."""
    letters = sorted({c for w in counts for c in w})
    form, rows = {}, []
    for w, n in counts.items():
        near = {x for x in one_edit(w, letters) if x in counts and x != w}
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
        rows.append((w, n, len(near)))
    out = []
    for w, n, n_near in rows:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near, counts[form[w]] if form[w] else None))
    return sorted(out)


def brute_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def crowd(rng, letters, n):
    """Words that share halves, and edits of them."""
    seeds = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 13))) for _ in range(n // 8)]
    words = set(seeds)
    for w in seeds:
        for _ in range(7):
            w = rng.choice(list(one_edit(w, letters)))
            if len(w) >= 6:
                words.add(w)
    words |= {"aaaaaa" + "a" * k for k in range(9)} | {"ab" * k for k in range(3, 8)}
    return {w: 5 + int(10 ** rng.uniform(0, 4)) for w in sorted(words)}


def variants(spark, counts, shard_rows):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.variants(df, shard_rows=shard_rows).collect())


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    for letters, n, shard_rows in (("ab", 500, 40_000), ("abé", 900, 60), ("abcdefghÿ", 900, 500)):
        counts = crowd(rng, letters, n)
        assert variants(spark, counts, shard_rows) == brute_variants(counts)


def test_crowded_halves_are_refined(spark):
    # all words share the last five letters, the windows in front of them are dealt on
    rng = random.Random(4)
    counts = {"".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 7))) + "thing": 5 + rng.randrange(500)
              for _ in range(1200)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.dealt(df, shard_rows=50)
    assert rows.filter("a > 0 AND b > 0").head(1)
    sizes = [r["count"] for r in rows.filter("m - a - b > 1").groupBy("group").count().collect()]
    assert max(sizes) <= 50
    assert variants(spark, counts, 50) == brute_variants(counts)


def test_each_pair_is_found_once():
    rng = random.Random(6)
    counts = crowd(rng, "ab", 400)
    words = sorted(counts)
    query, m, a, b = [], [], [], []
    for k, w in enumerate(words):
        for state in ((len(w), 0, len(w) - len(w) // 2), (len(w), len(w) // 2, 0)):
            query.append(k)
            for to, x in zip((m, a, b), state, strict=True):
                to.append(x)
    left, right = spelling.near_in_shard(words, *(np.array(x, np.int64) for x in (query, m, a, b)))
    pairs = list(zip(left.tolist(), right.tolist(), strict=True))
    have = {w: k for k, w in enumerate(words)}
    want = {(k, have[x]) for w, k in have.items() for x in one_edit(w, "ab") if x in have and x != w}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in catalog.op11_spelling_variants(spark, sf).collect())
    want = brute_variants(brute_counts(docs))
    assert got == want and sum(r[1] is not None for r in want) > 20


def test_edge_rows(spark, scratch):
    texts = [None, "", " 12 ", "Colour colours COLOUR ", "colour" * 3000, "×÷×÷×÷ Éclair éclair", "Éclairs"]
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    df.write.parquet(f"{scratch}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.op11_spelling_variants(spark, scratch).collect())
    assert got == brute_variants(brute_counts([r[:2] for r in rows]))
    assert {"colour", "colours", "Éclair", "éclair", "×÷×÷×÷", "colour" * 3000} <= {r[0] for r in got}
    none = spelling.vocabulary(spelling.damaged(spelling.words_of(df.limit(0))))
    assert spelling.variants(none).collect() == []
    assert spelling.variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_a_chain_of_forms_leads_to_its_end(spark):
    counts = {"abcdefgh"[:6] + "x" * k: 5 ** (k + 1) for k in range(9)}
    got = variants(spark, counts, 40_000)
    assert got == brute_variants(counts) and {r[2] for r in got} == {"abcdefxxxxxxxx"}
