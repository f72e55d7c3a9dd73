"""The registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from splitwright.llm import audit, chats, decontaminate, disclosure, language, lattice, lines, middles, mixing, near, recipes, repeats, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_subword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.language_scores(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_groups(table(spark, sf_dir, "documents"))


def op9_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.pii_digest(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middles.middle_digest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.chat_digest(table(spark, sf_dir, "conversations").unionByName(chats.probe(spark), allowMissingColumns=True))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_decontamination": op5_decontamination,
    "op6_source_mixing": op6_source_mixing,
    "op7_subword_scores": op7_subword_scores,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_repeated_text": op9_repeated_text,
    "op10_personal_data": op10_personal_data,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_chat_format": op13_chat_format,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_line_dedup": lines.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op6_source_mixing": mixing.SQL,
    "op8_exact_dedup": recipes.SQL,
    "op11_fill_in_middle": middles.SQL,
    "op12_filter_audit": audit.SQL,
    "op13_chat_format": chats.SQL,
}
