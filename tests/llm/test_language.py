import zlib

from pyspark.sql import functions as F

from cartwise.llm import catalog, language

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_split(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op5_language_id(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)


def test_learning_sees_no_held_out_row(spark):
    rows = [(i, "aaa bbb ccc " * 5, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else "yy", "s") for i in range(60)]
    got = language.identify(spark.createDataFrame(rows, SCHEMA)).select("lang_pred").distinct().collect()
    assert [r[0] for r in got] == ["yy"]


def test_edge_rows(spark):
    rows = [(1, "the cat sat on the mat and the dog ran", "en", "s"), (2, "le chat et la souris dans le jardin", "fr", "s"),
            (3, None, "en", "s"), (4, "", None, "s"), (5, "123 !!", "en", "s"), (6, "the mat " * 20_000, None, "s"),
            (7, "the cat", "en", "s"), (7, "the cat", "en", "s"), (8, "² ½ Ⅷ _", "en", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    content = language.fit(df)
    assert sorted(content) == ["en", "fr"]
    got = {r["doc_id"]: r for r in language.classify(df, content).collect()}
    for i in (3, 4, 5, 8):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert (got[1]["lang_pred"], got[2]["lang_pred"]) == ("en", "fr")
    assert got[6]["lang_pred"] in content
    assert language.classify(df, content).filter("doc_id = 7").distinct().count() == 1
    nothing = language.classify(df, {}).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]
    assert language.identify(df.limit(0)).count() == 0
    assert language.identify(df.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_tie_is_rejected(spark):
    df = spark.createDataFrame([(1, "qqqq", None, "s")], SCHEMA)
    got = language.classify(df, {"b": b"xyz", "a": b"xyz"}).first()
    assert (got["lang_pred"], got["score"], got["rejected"]) == ("a", 0.0, True)
