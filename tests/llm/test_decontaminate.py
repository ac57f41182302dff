import re

import pytest

from cartwise.llm import catalog, decontaminate

ITEM = "If Alice buys 3 apples for 5 dollars each then how much does Alice pay for all of the apples in the bag"
BENCH = [(1, ITEM), (2, "What is the capital of France and how many people live there today"), (3, "two words"),
         (4, None), (5, "")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def found(spark, bench, texts, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(docs, bench, **options).collect()}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_copies_and_other_values(spark, bench, limit):
    other = ITEM.replace("Alice", "Bob").replace("3", "7").replace("5 dollars", "2.50 euros")
    texts = [f"look: {ITEM}? yes", f"one two. {other}. three", other.replace("does Bob", "does Carl"), ITEM.lower(),
             f"{ITEM} and again {other}", "clean text about the capital of France alone", None, "", "two words",
             "these two words", "x " * 50_000 + ITEM, ITEM.replace("buys", "sells").replace("pay", "get")]
    got = found(spark, bench, texts, broadcast_windows=limit)
    assert got == {(0, 1): "copy", (1, 1): "reparameterised", (4, 1): "reparameterised", (8, 3): "copy",
                   (9, 3): "copy", (10, 1): "copy"} | {k: v for k, v in got.items() if k == (3, 1)}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_items_shorter_than_a_window(spark, limit):
    items = spark.createDataFrame([(1, "Who wrote Hamlet exactly?"), (2, "two words"), (3, "One"), (4, "two words"),
                                   (5, "costs 5 kg")], "item_id long, text string")
    texts = ["Q: who wrote HAMLET, exactly? A: him", "Who wrote Hamlet?", "two words and two words", "two (words)", "words two",
             "someone", "that one", "it costs 5 kg", "costs 6 kg", None, "", "word " * 20_000 + "two words"]
    got = found(spark, items, texts, broadcast_windows=limit)
    want = {(0, 1): "copy", (2, 2): "copy", (2, 4): "copy", (3, 2): "copy", (3, 4): "copy", (6, 3): "copy",
            (7, 5): "copy", (11, 2): "copy", (11, 4): "copy"}
    assert {k: v for k, v in got.items() if k != (8, 5)} == want and got.get((8, 5), "reparameterised") != "copy"


def test_long_runs_of_separators(spark, bench):
    runs = ["-" * 200_000, "." * 200_000, ", " * 100_000, "1.2.3," * 30_000, "\n" * 100_000 + ITEM, f"{ITEM}{'/' * 99_999}"]
    assert found(spark, bench, runs) == {(4, 1): "copy", (5, 1): "copy"}


def test_slots_must_be_consistent(spark, bench):
    broken = ITEM.replace("If Alice", "If Bob").replace("does Alice", "does Carl").replace("3", "7")
    assert found(spark, bench, [broken]) == {}


def test_letter_case_and_wrapping(spark):
    item = "In the old harbour, Alice met Bob, and Carla paid 7 coins, then every sailor went home before the storm"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("Alice", "Dora").replace("7", "9").upper()
    texts = [item.upper(), item.lower(), item.replace(" ", "\n  "), f"So: {item.title()}", other, f"{item.upper()} END"]
    got = found(spark, bench, texts)
    assert got == {(i, 1): "reparameterised" if i == 4 else "copy" for i in range(6)}
    assert got == found(spark, bench, texts, broadcast_windows=0)


def test_query_finds_all_windows_of_larger_table(spark):
    """Containment of windows, by a join of its own, on the larger table."""
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.1"

    def windows(table, key):
        words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{Nd}]+"), lambda w: w != "")
        at = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(
            F.slice("w", i, 5), " "))
        rows = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).alias(key), words.alias("w"))
        return rows.filter(F.size("w") >= 5).select(key, F.explode(at).alias("x"), F.size("w").alias("n"))
    items = windows("benchmark", "item_id").groupBy("item_id", "x", "n").agg(F.count("*").alias("times"))
    met = items.join(windows("documents", "doc_id").select("doc_id", "x").distinct(), "x").groupBy("doc_id", "item_id")
    brute = met.agg((F.sum("times") / (F.first("n") - 4)).alias("share")).filter("share >= 0.8").collect()
    got = catalog.op1_benchmark_decontamination(spark, sf).collect()
    assert brute and {(r["doc_id"], r["item_id"]) for r in got} == {(r["doc_id"], r["item_id"]) for r in brute}


def test_a_disagreeing_slot_costs_its_windows_only(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    item = " ".join(["12" if i in (10, 30) else w for i, w in enumerate(words)])
    pair = item.replace("12", "3", 1).replace("12", "5")
    sums = "add 3 and 4 and 5 and 6 and 7 and 8 and 9 and 10 and 11 and 12 then say what is the sum of it"
    bench = spark.createDataFrame([(1, item), (2, pair.replace("word", "term")), (3, sums)], "item_id long, text string")
    texts = [item.replace("12", "13", 1), f"{item.replace('12', '4', 1).replace('12', '7')} end",
             pair.replace("word", "term").replace(" 3 ", " 4 ").replace(" 5 ", " 4 "), sums.replace("sum", "total"),
             " ".join(f"{w} x" if i % 6 == 0 else w for i, w in enumerate(words))]
    got = found(spark, bench, texts)
    assert got == {(0, 1): "reparameterised", (1, 1): "reparameterised", (2, 2): "reparameterised", (3, 3): "reparameterised"}
    assert got == found(spark, bench, texts, broadcast_windows=0)


def test_names_at_sentence_starts(spark):
    item = ("Alice has 3 apples. Alice buys 5 more at the market. Alice then gives 2 to a friend.\n"
            "\"Alice must count them,\" says the friend")
    short = "Marie wrote the first long novel"
    bench = spark.createDataFrame([(1, item), (2, short), (3, item.replace("Alice", "Eve").replace("apples", "nuts").upper())],
                                  "item_id long, text string")
    texts = [item.replace("Alice", "Bob"), f"we ask: {item.replace('Alice', 'Bob').replace('5', '8')}", item.upper(),
             f"it is said that {short} of all", "She said that Jane wrote the first long novel", "She wrote the first long novel",
             "Then the man wrote the first short story", item.replace("Alice", "Eve").replace("apples", "nuts"),
             "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT"]
    got = found(spark, bench, texts)
    other = "reparameterised"
    assert {k: v for k, v in got.items() if k not in {(7, 1), (0, 3), (1, 3), (2, 3)}} == {
        (0, 1): other, (1, 1): other, (2, 1): "copy", (3, 2): "copy", (4, 2): other, (7, 3): "copy"}
    assert got == found(spark, bench, texts, broadcast_windows=0)


def test_repeated_null_and_empty(spark, bench):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, "fine")],
                                 "doc_id long, text string")
    assert decontaminate.leaks(docs, bench).count() == 2
    assert [r["doc_id"] for r in decontaminate.drop_leaked(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaked(docs, bench.limit(0)).count() == 5


def test_query_equals_brute_force(spark):
    """The tables hold no digits in the benchmark and capitals only at
    sentence starts, so five-word windows decide by themselves, but for a
    name mark where a passage begins inside a sentence."""
    sf = "/root/testdata/sf0.01"
    word = re.compile(r"[^\W_]+")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    texts = {r["doc_id"]: " " + " ".join(word.findall((r["text"] or "").lower())) + " " for r in docs}
    brute = set()
    for item in items:
        words = word.findall(item["text"].lower())
        windows = [f" {' '.join(words[i:i + 5])} " for i in range(len(words) - 4)]
        for doc, text in texts.items():
            if sum(w in text for w in windows) >= 0.8 * len(windows):
                brute.add((doc, item["item_id"]))
    got = catalog.op1_benchmark_decontamination(spark, sf).collect()
    assert brute and {(r["doc_id"], r["item_id"]) for r in got} == brute
    assert all(0.8 <= r["share"] <= 1 for r in got)


def test_native_plan(spark, bench):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = decontaminate.leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "BroadcastHashJoin" in plan


def test_long_document_of_repeated_items_fits_in_memory(spark, bench):
    """Every window of a long document can be a hit; a hit must not carry the whole document's words."""
    texts = [" ".join([ITEM] * 1500), f"look: {ITEM}? yes"]
    assert found(spark, bench, texts) == {(0, 1): "copy", (1, 1): "copy"}
