"""Query of the nearest-neighbour search (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docgauge.llm import ann
from docgauge.llm.common import table
from docgauge.llm.registry import query


@query("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
