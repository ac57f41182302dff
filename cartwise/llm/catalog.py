"""Registered queries of the training-data operators: each runs its operator
with production parameters over its whole table and derives the result's
digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import decontaminate, language, licenses, mixing, periodic, pieces, pivots, shards, \
    simhash, spelling, token_counts, url_rules, warc
from cartwise.llm.oracle import LLM_ORACLE

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", "share", "kind")


def op2_license_scan(spark, sf_dir):
    places = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base_places", lambda p: p["start"])
    base_labels = F.transform("base_places", lambda p: p["label"])
    weights = F.transform(F.concat("base_places", "detections"), lambda p: p["weight"])
    return places.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        licenses.joined_labels(F.concat("base_places", "detections")).alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"))


def op3_sentencepiece(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_embedding_near_dedup(spark, sf_dir):
    found = pivots.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_sharding(spark, sf_dir):
    placed = shards.shard_places(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0))
                                                        .cast("long")), tokenizer_path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"))


def op8_simhash(spark, sf_dir):
    groups = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
                         "component_id")


def op9_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filter(spark, sf_dir):
    judged = url_rules.judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def op11_spelling_variants(spark, sf_dir):
    words = spelling.damaged(spelling.words_of(read(spark, sf_dir, "documents")))
    return spelling.variants(spelling.vocabulary(words))


def op12_source_mixing(spark, sf_dir):
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "rate", "copies")


def op13_periodic_runs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", periodic.planted("doc_id", "text").alias("text"))
    found = periodic.runs_of(docs).withColumn("best", periodic.strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_license_scan, op3_sentencepiece, op4_embedding_near_dedup, op5_language_id,
    op6_sharding, op7_token_counts, op8_simhash, op9_warc, op10_url_filter,
    op11_spelling_variants, op12_source_mixing, op13_periodic_runs)}
