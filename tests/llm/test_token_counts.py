import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartwise.llm import catalog, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "'s", "'", "a", "The", "\n", "\t", ".", "é", "İ", "ΑΣ ", "😀", "<|endoftext|>", "<|startoftext|>", "<|end",
         "1", "²", "½", "ß", "ﬁ", "\x00", "\xa0", "日本", "é", "'ll", "!!", "“", "_", "\x1c", "ſ", "K", "x" * 70, "×"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_cut_and_lengths_equal_library(library):
    cutter, lengths = token_counts.Cutter(library), token_counts.Lengths(library, {})
    random.seed(4)
    for _ in range(4000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 10)))
        words, specials = cutter.cut(text)
        assert sum(lengths[w] for w in words) + specials == count(library, text), text


MARKS = [" ", "a", "İ", "i", "é", "Σ", "日", "ﬁ", "가", "ᄀ", "ᅡ", "\u0301", "\u0316", "\u0327", "\u0307", "\u0591", "\u05b4",
         "\u0323", "\u0345", "\u093c", "\u3099", "1", "'s", ".", "K", "Å"]


def test_combining_marks_are_normalised_once(library):
    cutter, lengths = token_counts.Cutter(library), token_counts.Lengths(library, {})
    rng = random.Random(7)
    texts = ["İ\u0591", "İ\u0327", "İ\u0316x"] + ["".join(rng.choice(MARKS) for _ in range(rng.randint(1, 8)))
                                                  for _ in range(10_000)]
    for text in texts:
        words, specials = cutter.cut(text)
        assert sum(lengths[w] for w in words) + specials == count(library, text), ascii(text)


def test_summaries_hold_the_heavy_hitters_of_all_rows(spark, library):
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)]
    texts = [" ".join(["often"] * 3 + [rng.choice(words) for _ in range(12)]) for _ in range(900)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(70)
    with open(PATH, "rb") as f:
        content = f.read()
    got = token_counts.frequent_lengths(df, "text", content, keep=20)
    assert "often" in got and len(got) <= 20
    assert all(n == count(library, w) for w, n in got.items())
    whole = token_counts.frequent_lengths(df, "text", content)
    assert "often" in whole and len(whole) > 300
    kept = token_counts.lessened({"a": 9, "b": 5, "c": 2, "d": 2}, 2)
    assert kept == {"a": 7, "b": 3}


def test_no_exchange_of_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = token_counts.count_tokens(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_full_table_starts_over(library, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_SIZE", 3)
    lengths = token_counts.Lengths(library, {"the": 1})
    for w in ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "the"]:
        assert lengths[w] == count(library, w)
    assert len(lengths) <= 5 and "the" in lengths


def test_pack_round_trip():
    for d in ({}, {"a": 1}, {"a": 1, "bb": 300, "c": 255, "d": 0, "e": 510}):
        assert token_counts.unpack(*token_counts.pack(d)) == d


def test_other_vocabulary_is_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f, pytest.raises((ValueError, KeyError, TypeError)):
        token_counts.check_vocabulary(f.read())


def test_edge_rows(spark, library):
    texts = [None, "", "a", "a", "word " * 30_000, "<|endoftext|> x", "日本 é"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, PATH).collect()}
    assert got == {i: count(library, t) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def test_query_equals_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in catalog.op7_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = count(library, r["text"])
        own = got.pop(r["doc_id"])
        assert (own["n_tokens"], own["over_limit"]) == (n, n > 2048)
        assert own["n_bytes"] == len((r["text"] or "").encode())
    assert not got
