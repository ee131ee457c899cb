"""Query of the language-model scores (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docgauge.llm import lm
from docgauge.llm.common import table
from docgauge.llm.registry import query

OP4_SQL = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
tokens AS (SELECT r, i, w[i] AS v, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
sizes AS (SELECT r, count(*) AS n FROM tokens GROUP BY r),
whole AS (SELECT count(*) AS n FROM tokens),
own1 AS (SELECT r, v, count(*) AS n FROM tokens GROUP BY r, v),
all1 AS (SELECT v, sum(n) AS n FROM own1 GROUP BY v),
rest1 AS (SELECT r, own1.v, all1.n - own1.n AS n FROM own1 JOIN all1 USING (v)),
own2 AS (SELECT r, u, v, count(*) AS n FROM tokens WHERE u IS NOT NULL GROUP BY r, u, v),
all2 AS (SELECT u, v, sum(n) AS n FROM own2 GROUP BY u, v),
rest2 AS (SELECT r, u, own2.v, all2.n - own2.n AS n FROM own2 JOIN all2 USING (u, v)),
scored AS (
  SELECT t.r, coalesce(b.n, 0) > 0 AS hit, w.n = 0 AS unseen,
    CASE WHEN b.n > 0 THEN ln(b.n::DOUBLE) - ln(c.n::DOUBLE)
      ELSE CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END
        + CASE WHEN w.n > 0 THEN ln(w.n::DOUBLE) - ln((whole.n - s.n)::DOUBLE) ELSE -ln((whole.n - s.n + 1)::DOUBLE) END END AS score
  FROM tokens t JOIN sizes s USING (r) CROSS JOIN whole JOIN rest1 w ON w.r = t.r AND w.v = t.v
  LEFT JOIN rest1 c ON c.r = t.r AND c.v = t.u LEFT JOIN rest2 b ON b.r = t.r AND b.u = t.u AND b.v = t.v),
summed AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (hit) AS n_hits, count(*) FILTER (unseen) AS n_unseen, sum(score) AS score FROM scored GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hits, 0) AS n_hits, coalesce(n_unseen, 0) AS n_unseen,
  coalesce(round(score / n_words, 4), 0) AS mean_log_score
FROM words LEFT JOIN summed USING (r)
"""


@query("op4_backoff", OP4_SQL)
def op4_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.backoff_scores(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 4)).otherwise(0.0)
    return found.select("doc_id", "n_words", "n_hits", "n_unseen", mean.alias("mean_log_score"))
