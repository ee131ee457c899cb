"""Queries of the operators that learn: quality (2), language (3) and toxicity (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import quality, toxicity
from docgauge.llm.common import table
from docgauge.llm.registry import query


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
