"""A corpus pipeline: five stages over ``documents``, each an operator of ``evaquery.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
frame. Run stage by stage, each result is written as Parquet and read as the next
stage's ``docs``; ``run`` does so in the folder that the cluster shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evaquery.llm import bpe, decontaminate, quality, simhash, templates
from evaquery.llm.common import documents, scratch, stored
from evaquery.llm.queries import pattern, tokenizer
from evaquery.llm.sample import fold


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others stay as they are.

    A null text is judged as an empty one; equal rows share their fate; no rows give none.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 3) != 1)
    return quality.accepted(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines go but for their first; n_chars follows the text.

    A null text stays null and has null n_chars, a text may become empty; no rows give none.
    """
    cleaned = templates.without_recurring_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, five-word shingles alike by 0.8 or more, the document with the least doc_id stays.

    Null and empty texts are one group; rows with a null doc_id stay; no rows give none.
    """
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain none and stay; repeated rows share their fate; no rows give none.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row for each row; a null text counts as empty."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_and_decode),
]

#: SQL can express neither the classifier nor the merges; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; the last one's result is left to the caller's action.

    What a stage stores on its way is removed when its result is written.
    """
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
