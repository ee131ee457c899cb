"""Query of the cross-tokenizer alignment (12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import alignment
from docgauge.llm.common import table
from docgauge.llm.registry import query


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))
