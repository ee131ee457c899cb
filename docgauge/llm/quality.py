"""Quality: trusted good documents against unlabelled web text, by positive-unlabelled learning (``pu``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docgauge.llm import pu
from docgauge.llm.common import split_of


def quality_model(docs: DataFrame, labels: DataFrame, **bounds) -> pu.Model:
    """Learns from documents outside part 0 of 5 (by ``split_of``); positives are labels with quality 1, once each.

    Style measures alone by default (``n_grams`` 0): n-grams would learn the topics and languages of the trusted documents.
    """
    return pu.fit(docs, labels.where("quality = 1"), split_of(F.col("doc_id"), 5) != 0, **({"n_grams": 0} | bounds))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **bounds) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text).

    Null and empty texts are scored by their style measures alone. Repeated rows get equal scores; a null id is scored and
    counts as held out. Without enough labels every score is 0.5. No rows give no rows; other columns are left out.
    """
    return judged(docs, quality_model(docs, labels, **bounds), cut)


def judged(docs: DataFrame, model: pu.Model, cut: float) -> DataFrame:
    held_out = split_of(F.col("doc_id"), 5) == 0
    return pu.scored(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: pu.Model, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns, text among them) that the model does not reject."""
    good = pu.scored(docs, model).where(F.col("score") >= cut)
    return good.select(*docs.columns)
