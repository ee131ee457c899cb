"""Query of language identification (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docgauge.llm import language
from docgauge.llm.common import split_of, table
from docgauge.llm.registry import query


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_of(F.col("doc_id"), 3) == 1
    found = language.languages(docs, ~held_out & F.col("doc_id").isNotNull())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
