"""Toxicity: confirmed toxic documents against unlabelled text, by positive-unlabelled learning (``pu``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docgauge.llm import pu
from docgauge.llm.common import split_of
from docgauge.llm.quality import judged


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **bounds) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text); ``score`` is the probability of being toxic.

    Learns from documents outside part 0 of 5 and from labels with toxic 1 alone, by n-grams and not by style. Null and empty
    texts have the score of a text without telling n-grams. Repeated rows get equal scores; a null id is scored and counts as held out. Without enough labels every
    score is 0.5. No rows give no rows; other columns are left out.
    """
    model = pu.fit(docs, labels.where("toxic = 1"), split_of(F.col("doc_id"), 5) != 0, **({"styled": False} | bounds))
    return judged(docs, model, cut)
