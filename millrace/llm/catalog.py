"""The registered corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontaminate, host_rules, main_text, oracles, pii, secret_scan, sharding, simhash, token_store, weak_labels
from millrace.llm.common import table, text_or_empty
from millrace.llm.digests import count_kind, joined_spans, sha


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep_text=False).select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        sha(F.array_join(F.col("token_ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_rules.judge(docs).select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_or_empty(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    base = secret_scan.KINDS[: secret_scan.BASE]
    return secret_scan.scan(docs, keep_text=False).select(
        "doc_id",
        *[count_kind("secret_spans", k).alias(f"n_{k}") for k in base],
        sha(joined_spans("secret_spans", base)).alias("base_sha256"),
        joined_spans("secret_spans").alias("spans"),
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = pii.KINDS[: pii.BASE]
    return pii.find(docs).select(
        "doc_id",
        *[count_kind("pii_spans", k).alias(f"n_{k}") for k in base],
        sha(joined_spans("pii_spans", base)).alias("base_sha256"),
        joined_spans("pii_spans").alias("spans"),
        F.size("pii_spans").cast("bigint").alias("all_spans"),
        F.array_join(F.transform("pii_spans", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_join(F.sort_array(F.col("item_ids").cast("array<string>")), ",")
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep_text=False).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        sha(ids).alias("items_sha256"),
        "contaminated",
    )


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path(token_store.VOCABULARY))
    return token_store.read(spark, store)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = weak_labels.score(docs, keep_text=False)
    return scored.select("doc_id", F.round("quality_posterior", 6).alias("posterior"), F.round("quality_score", 6).alias("score"), F.col("quality_ok").alias("kept"))


QUERIES = {f.__name__: f for f in (op1_main_text, op2_byte_bpe, op3_host_rules, op4_simhash, op5_secrets, op6_personal_data, op7_shards, op8_decontamination, op9_token_store, op10_quality)}
ORACLES: dict[str, str] = {"op3_host_rules": oracles.OP3, "op8_decontamination": oracles.OP8}
