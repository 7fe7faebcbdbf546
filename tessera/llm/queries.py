"""The registered queries of the operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import collocations, decontaminate, divergence, mixing, url_filter
from tessera.llm.language_id import identify_languages
from tessera.llm.media import media_digest
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.pii import pii_digest
from tessera.llm.secrets import secrets_digest
from tessera.llm.sharding import shard_documents
from tessera.llm.store import table
from tessera.llm.substring_dedup import repeats_digest
from tessera.llm.toxicity import score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "mix_copies", "mix_copy", "mix_key")


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 16, ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "key string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_toxicity, op2_gif_media, op3_substring_dedup, op4_secret_scan, op5_pii, op6_language_id, op7_benchmark_decontamination, op8_minhash_near_dedup, op9_poisson_mixing, op10_jump_sharding,
            op11_source_divergence, op12_collocations, op13_url_filter)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op7_benchmark_decontamination": decontaminate.ORACLE_SQL, "op9_poisson_mixing": mixing.ORACLE_SQL,
            "op11_source_divergence": divergence.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL, "op13_url_filter": url_filter.ORACLE_SQL}
