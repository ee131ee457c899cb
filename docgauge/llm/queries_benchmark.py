"""Query of the benchmark decontamination (1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import decontamination
from docgauge.llm.common import table
from docgauge.llm.registry import query


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "reordered")
