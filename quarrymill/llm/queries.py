"""The queries opN_<name> of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fill_middle, filter_audit, html_text, mixing, multi_index, near_dedup, packing, pii, quality_lm, quality_rules, sql, toxicity, url_filters
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(read(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(read(spark, sf_dir, "pages"), url_filters.default_list(spark))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.neighbours_of_every(read(spark, sf_dir, "embeddings"), 100, 10)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_html_extraction": op5_html_extraction,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLE_SQL = {
    "op2_quality_rules": sql.QUALITY_RULES,
    "op4_mixing": sql.MIXING,
    "op6_url_filters": sql.URL_FILTERS,
    "op10_exact_dedup": sql.EXACT_DEDUP,
    "op11_fill_in_middle": sql.FILL_IN_MIDDLE,
    "op12_filter_audit": sql.FILTER_AUDIT,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
