"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, line_dedup, merkle, mixing, quality, resampling, sharding, simhash, spotsigs, substring, token_store, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op3(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op4(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op5(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op6(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.op10(table(spark, sf_dir, "documents"))


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.op11(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op12(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_simhash_near_dedup, op4_substring_dedup, op5_html_extraction, op6_line_dedup, op7_quality_rules, op8_mixing, op9_sharding, op10_token_output, op11_spotsigs, op12_merkle_manifest, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.SQL, "op4_substring_dedup": substring.SQL, "op6_line_dedup": line_dedup.SQL, "op7_quality_rules": quality.SQL, "op11_spotsigs": spotsigs.SQL, "op12_merkle_manifest": merkle.SQL, "op13_importance_resampling": resampling.SQL}
