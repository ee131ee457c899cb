"""What to fix first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docgauge.functions.numbers import round1
from docgauge.operators.answers import miss_cause_fix
from docgauge.operators.common import first_n

_COLUMNS = ["site_key", "check_id", "title", "fix", "points"]


def top_fixes(checks: DataFrame, n: int = 3) -> DataFrame:
    """The changes that would recover the most points: by points lost, failures before warnings, then check order."""
    lost = round1(F.col("max") - F.col("earned"))
    open_checks = checks.filter(
        F.col("status").isin("fail", "warn") & F.col("fix").isNotNull() & (F.col("fix") != "") & F.col("earned").isNotNull()
    ).withColumn("points", lost)
    rank = F.when(F.col("status") == "fail", 0).otherwise(1)
    ranked = first_n(
        open_checks.filter(F.col("points") > 0), ["site_key"], [F.col("points").desc(), rank, F.col("check_ord")], n, "fix_ord"
    )
    return ranked.select("site_key", "fix_ord", F.col("id").alias("check_id"), "title", "fix", "points")


def answer_fix(fixes: DataFrame, checks: DataFrame, rollup: DataFrame, entries: DataFrame) -> DataFrame:
    """One combined fix leads in place of the answer checks' own when at least two answers missed and under 80% held."""
    lost = checks.filter((F.col("group") == "answerability") & F.col("earned").isNotNull()).groupBy("site_key").agg(
        round1(F.sum(F.col("max") - F.col("earned"))).alias("points")
    )
    low = rollup.filter(
        (F.col("state") == "complete") & (F.col("total") > 0) & (F.col("correct") / F.col("total") < 0.8)
    ).select("site_key", "total")
    causes = miss_cause_fix(entries).filter((F.col("misses") >= 2) & F.col("fix").isNotNull())
    lead = low.join(causes, "site_key").join(lost, "site_key", "left").select(
        "site_key",
        F.lit("answerability").alias("check_id"),
        F.concat(
            F.lit("Agents could not answer "), F.col("misses").cast("string"), F.lit(" of "), F.col("total").cast("string"),
            F.lit(" questions"),
        ).alias("title"),
        "fix",
        F.coalesce("points", F.lit(0.0)).alias("points"),
        F.lit(0).alias("fix_ord"),
    )
    answer_checks = checks.filter(F.col("group") == "answerability").select("site_key", F.col("id").alias("check_id"))
    replaced = fixes.join(answer_checks.join(lead.select("site_key"), "site_key", "left_semi"), ["site_key", "check_id"], "left_anti")
    both = replaced.select(*_COLUMNS, "fix_ord").unionByName(lead.select(*_COLUMNS, "fix_ord"))
    return first_n(both.withColumnRenamed("fix_ord", "__old"), ["site_key"], [F.col("points").desc(), F.col("__old")], 3, "fix_ord").select(
        "site_key", "fix_ord", "check_id", "title", "fix", "points"
    )


def fix_order(checks: DataFrame, fixes: DataFrame) -> DataFrame:
    """Adds ``problem_ord`` to failing and partly passing checks: top fixes first in their order, then by points lost.

    A site has at most a few dozen checks, one per check id, so the ranking window is bounded by the method itself.
    """
    problems = checks.filter(F.col("status").isin("fail", "warn"))
    marked = problems.join(
        fixes.select("site_key", F.col("check_id").alias("id"), "fix_ord"), ["site_key", "id"], "left"
    )
    lost = F.col("max") - F.coalesce("earned", F.lit(0.0))
    order = Window.partitionBy("site_key").orderBy(
        F.coalesce("fix_ord", F.lit(2**31 - 1)), F.when(F.col("fix_ord").isNull(), -lost), F.col("check_ord")
    )
    return marked.withColumn("problem_ord", F.row_number().over(order)).drop("fix_ord")
