import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cartwise.llm import catalog, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "the", "\n", "▁", ".", "é", "😀", "\t", "in", "<s>", "</s>", "<0x0A>", "0", "1", "ß", "ﬁ",
         "\x00", "日本", "é", "   ", "x" * 60, "aa" * 100, "'s", "²."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_agenda_equals_library(library):
    table = pieces.ChunkTable(pieces.Merger(library))
    random.seed(5)
    for _ in range(3000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 14)))
        chunks = pieces._chunks(text.replace(pieces.SPACE, " ")) if text else []
        ids = np.frombuffer(b"".join(map(table.__getitem__, chunks)), np.int32).tolist()
        assert ids == library.encode(text), text
        assert table.merger.decode(ids) == library.decode(ids), text
    table.check()


def test_heap_and_flat_agenda_agree(library):
    merger = pieces.Merger(library)
    random.seed(6)
    for _ in range(300):
        chunk = pieces.SPACE + "".join(random.choice("aeinrst") for _ in range(random.randint(1, 40)))
        assert merger.merge(chunk) == merger._merge_heap(chunk)


def test_mismatch_fails(library):
    table = pieces.ChunkTable(pieces.Merger(library))
    table.fresh.append(("word", b"\x00\x00\x00\x00"))
    with pytest.raises(pieces.LibraryMismatch):
        table.check()


def test_edge_rows_and_clashing_columns(spark, library):
    texts = [None, "", " ", "a b", "a b", "x" * 50_000, "\n\n", "▁"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    got = {r["doc_id"]: r for r in pieces.encode_decode(df, PATH).collect()}
    for i, t in enumerate(texts):
        assert got[i]["piece_ids"] == library.encode(t or "")
        assert got[i]["decoded"] == library.decode(library.encode(t or ""))
        assert got[i]["text"] == t
    empty = pieces.encode_decode(df.limit(0), PATH)
    assert empty.columns == ["doc_id", "text", "piece_ids", "decoded"] and empty.count() == 0


def test_query_equals_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in catalog.op3_sentencepiece(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "")
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids)
        assert own["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_plan_has_no_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id"), "text")
    assert "Exchange" not in pieces.encode_decode(df, PATH)._jdf.queryExecution().toString()
