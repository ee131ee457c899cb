"""From raw documents to a training mix: quality, near duplicates, repeated strings, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``; what a stage rejects is gone for those after it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import decontamination, mixing, quality, similar, suffix
from docgauge.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects. It learns from these docs and the labels outside part 0 of 5."""
    docs = docs.select(*COLUMNS)
    return quality.kept(docs, quality.quality_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group that five-word shingles link: by fingerprints of at most 3 bits or a similarity of 0.8."""
    return similar.first_of_groups(docs.select(*COLUMNS), width=5)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 200 bytes that also starts elsewhere out of the texts; all documents stay."""
    return suffix.without_repeats(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least half of a benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per remaining document with its size, its source's size and target, and the words that the mix takes of it."""
    return mixing.taken_words(mixing.mix_sources(docs.select(*COLUMNS)))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
]

#: SQL cannot express the learned and hashed stages; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result lies in the shared folder until whoever keeps that deletes it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
