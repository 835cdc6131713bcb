"""The registered queries of this subpackage and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from voxelarium.llm import (
    decontamination,
    exact_dedup,
    fill_in_middle,
    language_id,
    line_dedup,
    main_text,
    packing,
    secrets,
    simhash,
    token_alignment,
    tokens,
    url_filter,
    vector_links,
)
from voxelarium.llm.common import read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_predictions(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.page_decisions(read(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.page_texts(read(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.middle_forms(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(read(spark, sf_dir, "documents"))


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_vectors(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_main_text": op10_main_text,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_links": op13_vector_links,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_decontamination": decontamination.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
}
