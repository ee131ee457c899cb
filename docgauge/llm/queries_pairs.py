"""Queries of the operators on pairs of documents or vectors: near duplicates (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import simhash
from docgauge.llm.common import table
from docgauge.llm.registry import query


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))
