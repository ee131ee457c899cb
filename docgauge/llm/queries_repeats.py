"""Query of the removal of repeated strings (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import suffix
from docgauge.llm.common import table
from docgauge.llm.registry import query


@query("op9_suffix")
def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents"))
