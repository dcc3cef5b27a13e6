"""Registered queries and oracle SQL of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wiretally.llm import (
    conversation_repair,
    decontaminate,
    golay_dedup,
    language_id,
    line_dedup,
    packing,
    quality,
    resample,
    secrets,
    simhash_prints,
    toxicity,
    url_filter,
    warc,
)
from wiretally.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_prints.with_edits(table(spark, sf_dir, "documents"))


def op9_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.with_digest(line_dedup.drop_lines(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}


def oracles() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.oracle(),
        "op6_warc_derivatives": warc.oracle(),
        "op12_resample": resample.oracle(),
        "op13_line_dedup": line_dedup.oracle(),
    }
