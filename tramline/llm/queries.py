"""The registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import common, decontam, html_wrapper, licenses, line_crf, near_dup, pieces, pii, quality_rules, toxicity, trie_counts


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score_documents(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_hits(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
    return decontam.digest(found)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(common.read_table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find_groups(common.read_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.read_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they give it back."""
    return pieces.encode(common.read_table(spark, sf_dir, "documents"), round_trip=True)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(common.read_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.count_tokens(common.read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_pii, op3_near_duplicates, op4_licenses, op5_sentencepiece, op6_html, op10_token_counts, op7_quality_rules, op8_quality_classifier, op9_decontamination]
    return {f.__name__: f for f in own}
