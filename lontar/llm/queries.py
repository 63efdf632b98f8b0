"""The registered queries of this subpackage: one opN_<name> for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm import decontaminate, language, lm_score, media, mixing, near_dup, pii, secrets, token_ids, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(_documents(spark, sf_dir)))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("node")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), counts=True)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: the vocabulary file's path, by default the public byte-level one."""
    import public_tokenizers

    return token_ids.read_index(token_ids.write(_documents(spark, sf_dir), tokenizer or public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_lm_score": op2_lm_score,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op8_token_ids": op8_token_ids,
    "op9_near_dup": op9_near_dup,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE_SQL}
