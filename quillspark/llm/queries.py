"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, centroids, chat, codes, decontaminate, langid, mixing, near_dup, quality, sharding, substring, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.label_documents(docs, langid.learn(docs))


def op5_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op8_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group_documents(table(spark, sf_dir, "documents"), threshold=0.85)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op11_drake_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_substring_dedup, op2_toxicity_cnn, op3_language_id, op4_jump_shards, op5_bm25_decontamination,
    op6_warc_revisits, op7_crf_quality, op8_setsketch_near_dedup, op9_byte_bpe, op10_chat_prefix_targets,
    op11_drake_centroids, op12_exponion_codes, op13_source_mix,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring.ORACLE_SQL, "op8_setsketch_near_dedup": near_dup.ORACLE_SQL, "op6_warc_revisits": warc.ORACLE_SQL, "op10_chat_prefix_targets": chat.ORACLE_SQL,
        "op11_drake_centroids": centroids.ORACLE_SQL, "op12_exponion_codes": codes.ORACLE_SQL, "op13_source_mix": mixing.ORACLE_SQL,
    }
