import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from test_simhash import classes, fingerprint

import corpus_pipeline
from cartwise.llm import language
from cartwise.plans.materialize import scratch_path

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, content):
    """The four stages, document by document."""
    rejected = language._classify(content, language.MIN_MARGIN, 0)(
        pa.RecordBatch.from_arrays([pa.array([d["text"] for d in docs], pa.string())], names=["text"]))[2].to_pylist()
    docs = sorted((d for d, r in zip(docs, rejected) if not r), key=lambda d: d["doc_id"])
    cls = classes([fingerprint(d["text"]) for d in docs], 2)
    docs = [d for i, d in enumerate(docs) if cls[i] == i]
    clean = []
    for d in docs:
        text = f" {' '.join(WORD.findall((d['text'] or '').lower()))} "
        hit = False
        for item in items:
            words = WORD.findall(item["text"].lower())
            windows = [f" {' '.join(words[i:i + 5])} " for i in range(len(words) - 4)]
            hit = hit or sum(w in text for w in windows) >= 0.8 * len(windows)
        if not hit:
            clean.append(d)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {d["doc_id"]: library.encode(d["text"] or "") for d in clean}


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    content = language.fit(table.filter(~language.held_out()))
    want = brute(table.collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect(), content)
    got = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"]: list(r["piece_ids"]) for r in got.collect()} == want
    assert got.count() == len(want) < table.count()
    assert got.columns == [*table.columns, "piece_ids"]


def test_stages_keep_columns_and_take_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd = table.unionByName(table).unionByName(
        spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0)], table.schema))
    for docs in (odd, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, f"pipeline-test-{id(docs)}-{name}")
            out = stage(spark, docs, sf)
            assert out.columns[:5] == table.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.groupBy("doc_id").count().filter("count > 1").count() == 0 or name == "language_id"


def test_decontamination_stage_takes_long_documents(spark):
    """A long document that holds a benchmark item all along goes, without memory by the square of its length."""
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, " ".join([item] * (150_000 // len(item)))), (2, "nothing of the kind in this text")],
                                 "doc_id long, text string")
    kept = corpus_pipeline.decontaminate_benchmark(spark, docs, sf)
    assert [r["doc_id"] for r in kept.collect()] == [2]
