"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, langid, lpf, oracles, pfor, pii, quality, resample, rules, simhash, templates, tokencount
from .common import documents
from .sample import fold


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; the files are installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The split that goes with the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def held_out(folds: int, kept_back: int):
    """Whether a doc_id is in the fold kept back from training; a null id is not."""
    return F.coalesce(fold(F.col("doc_id"), folds) == kept_back, F.lit(False))


def op1_pii_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir)).drop("class_distance", "common_distance")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_files(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=1)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), limit=512)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.line_dedup(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"), pattern())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2, per_label=1000)
    return langid.languages(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, fold(F.col("doc_id"), 3) != 1, per_label=2000)
    return quality.scores(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op11_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.repeat_report(lpf.without_repeats(documents(spark, sf_dir), length=50))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(fim.fill_in_middle(documents(spark, sf_dir), percent=50, spm_percent=80, seed="42"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample.resampled(documents(spark, sf_dir), target, n=1, buckets=10_000, percent=10, least_words=20, seed="2024")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_offsets": op1_pii_offsets,
    "op2_quality_rules": op2_quality_rules,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_token_id_files": op4_token_id_files,
    "op5_token_counts": op5_token_counts,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_line_templates": op7_line_templates,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_longest_previous_factor": op11_longest_previous_factor,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE: dict[str, str] = {
    "op2_quality_rules": oracles.quality_rules(),
    "op7_line_templates": oracles.line_templates(),
    "op11_longest_previous_factor": oracles.repeats(),
    "op12_fill_in_middle": oracles.fill_in_middle(),
    "op13_importance_resampling": oracles.resampled(),
}
