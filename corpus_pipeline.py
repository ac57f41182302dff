"""The corpus pipeline: language ID, SimHash near-duplicates, benchmark
decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All stages but the
last return the columns of ``documents``; rows are only ever dropped by a
stage's own decision. Empty tables, null columns and extra columns pass
through (see the operators' docstrings for each case).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartwise.llm import catalog, decontaminate, language, pieces, simhash
from cartwise.plans.materialize import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; rejected ones go."""
    return language.identify(docs).filter("NOT rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaked(docs, catalog.read(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids; ``decoded`` is checked inside the
    operator and equals the text but for space marks, so it is not kept."""
    return pieces.encode_decode(docs, catalog.tokenizer_path("piece_bpe_32k.model")).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

#: Compression and fingerprints have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.read(spark, sf_dir, "documents")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
