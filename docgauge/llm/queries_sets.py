"""Query of the similarity join of shingle sets (11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import setjoin
from docgauge.llm.common import table
from docgauge.llm.registry import query


@query("op11_setjoin")
def op11_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_sets(table(spark, sf_dir, "documents"))
