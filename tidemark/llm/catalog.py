"""Queries of the training-data operators and, where SQL can say them, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import classifier, codes, decontaminate, jaccard, licenses, lm, mixing, nearest, rules, runs, secrets, substrings, warc
from tidemark.llm.common import table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op1_query(table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op2_query(table(spark, sf_dir, "pages"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3_query(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op4_query(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.op5_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op6_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op7_query(table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op8_query(table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op9_query(table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op10_query(table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.op11_query(table(spark, sf_dir, "embeddings"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.op12_query(table(spark, sf_dir, "embeddings"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.op13_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _op1,
    "op2_warc": _op2,
    "op3_source_mix": _op3,
    "op4_ngram_jaccard": _op4,
    "op5_quality_classifier": _op5,
    "op6_decontaminate": _op6,
    "op7_substring_dedup": _op7,
    "op8_license_scan": _op8,
    "op9_secret_scan": _op9,
    "op10_lm_scores": _op10,
    "op11_vector_codes": _op11,
    "op12_nearest": _op12,
    "op13_periodic_runs": _op13,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": rules.ORACLE,
    "op2_warc": warc.ORACLE,
    "op11_vector_codes": codes.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLE | whole
