"""Points to scores: groups, grades, caps, provisional flags and the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docgauge import constants as K
from docgauge.functions.numbers import grade_for, number_text, percent, plural


def counted_checks(checks: DataFrame) -> DataFrame:
    """Checks that count: null points drop out of both sums."""
    return checks.filter(F.col("earned").isNotNull())


def _sums(condition: Column | None = None) -> tuple[Column, Column]:
    counts = F.col("earned").isNotNull()
    if condition is not None:
        counts = counts & condition
    return _tenths(F.when(counts, F.col("earned"))), _tenths(F.when(counts, F.col("max")))


def _tenths(points: Column) -> Column:
    """Sum of points, which have one decimal, as whole tenths: it does not depend on the order of rows."""
    return F.coalesce(F.sum(F.floor(points * 10 + 0.5).cast("bigint")), F.lit(0)) / F.lit(10.0)


def site_totals(checks: DataFrame) -> DataFrame:
    """Every per-site total a score needs from one aggregation, partial sums first: a hot site costs one row a task."""
    parts = []
    for name in K.GROUP_LABELS:
        earned, possible = _sums(F.col("group") == name)
        parts += [earned.alias(f"{name}_earned"), possible.alias(f"{name}_possible")]
    earned, possible = _sums()
    currency = F.col("earned").isNotNull() & (F.col("group") == "freshness") & F.col("category").isin(*K.CURRENCY_CATEGORIES)
    return checks.groupBy("site_key").agg(
        earned.alias("earned"),
        possible.alias("possible"),
        *parts,
        F.bool_or(currency).alias("has_currency"),
        F.count_if(F.col("status") != "skip").alias("applicable"),
        F.count_if(F.col("status") == "unverified").alias("unverified"),
    )


def group_score(checks: DataFrame, answerability: DataFrame | None = None) -> DataFrame:
    """Three rows per site. ``answerability``: ``site_key, state, reason``; without it the part counts as complete."""
    totals = site_totals(checks)
    if answerability is None:
        totals = totals.withColumns({"state": F.lit("complete"), "reason": F.lit(None).cast("string")})
    else:
        totals = totals.join(answerability.select("site_key", "state", "reason"), "site_key", "left")
        totals = totals.withColumn("state", F.coalesce("state", F.lit("unavailable")))
    return totals.select("site_key", F.explode(F.array(*group_structs())).alias("g")).select("site_key", "g.*")


def score_rollup(checks: DataFrame) -> DataFrame:
    """Points of the whole run, of each site, of its groups and of their categories in one table.

    ``level`` says what a row sums over: 0 the run, 1 a site, 2 a group, 3 a category; keys below it are null (a key that is null in the data
    keeps its own rows, told apart by ``level``). ``checks`` counts rows, ``counted`` those with points, ``possible`` their most. Points are summed as whole tenths once per
    category, with partial sums; only these few rows per site are expanded to the four levels. No check gives no rows but that of the run.
    """
    counts = F.col("earned").isNotNull()
    tenths = lambda c: F.coalesce(F.sum(F.when(counts, F.floor(F.col(c) * 10 + 0.5).cast("bigint"))), F.lit(0))
    fine = checks.groupBy("site_key", "group", "category").agg(
        F.count("*").alias("n"), F.count_if(counts).alias("c"), tenths("earned").alias("e"), tenths("max").alias("p"),
        F.count_if(F.col("status") == "unverified").alias("u"),
    )
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    level = F.lit(3) - F.bit_count(F.grouping_id().cast("bigint"))
    rows = fine.rollup("site_key", "group", "category").agg(
        level.cast("int").alias("level"), whole("n").alias("checks"), whole("c").alias("counted"), whole("u").alias("unverified"), whole("e").alias("e"), whole("p").alias("p")
    )
    # Half up on whole numbers: 100 e / p + 1/2 as a floor.
    score = F.when(F.col("p") > 0, F.expr("(200 * e + p) div (2 * p)").cast("int"))
    return rows.select(
        "level", "site_key", "group", "category", "checks", "counted", "unverified",
        (F.col("e") / 10).alias("earned"), (F.col("p") / 10).alias("possible"), score.alias("score"),
    )


def group_structs() -> list[Column]:
    """The three group results as structs over ``site_totals`` joined with the answerability state."""
    structs = []
    for ordinal, (name, label) in enumerate(K.GROUP_LABELS.items()):
        earned, possible = F.col(f"{name}_earned"), F.col(f"{name}_possible")
        untested = F.lit(False) if name != "answerability" else F.col("state") != "complete"
        empty = untested | (possible == 0)
        state = F.when(untested, F.col("state")).when(empty, "unavailable").otherwise("complete")
        note = F.lit(None).cast("string")
        if name == "freshness":
            note = F.when(empty, "No freshness check could run on this site.").when(
                ~F.col("has_currency"),
                "Maintenance only: no API spec was found, so nothing here verifies that the content is current.",
            )
        elif name == "access":
            note = F.when(empty, "None of the access checks could run.")
        else:
            note = (
                F.when(
                    F.col("state") == "pending",
                    "An agent is answering questions from these pages now; this part is added when it finishes.",
                )
                .when(untested, F.coalesce("reason", F.lit("Answerability was not tested in this scan.")))
                .when(empty, "None of the access checks could run.")
            )
        structs.append(
            F.struct(
                F.lit(ordinal).alias("group_ord"),
                F.lit(name).alias("group"),
                F.lit(label).alias("label"),
                state.alias("state"),
                F.when(untested, 0.0).otherwise(earned).alias("earned"),
                F.when(untested, 0.0).otherwise(possible).alias("possible"),
                F.when(~empty, percent(earned, possible)).alias("score"),
                note.alias("note"),
            )
        )
    return structs


def provisional_parts() -> Column:
    """Reasons a score is provisional, over totals joined with ``pages_tested, rate_limited``."""
    pages, limited = F.col("pages_tested"), F.col("rate_limited")
    share = F.col("unverified") / F.when(F.col("applicable") > 0, F.col("applicable"))
    return F.array_compact(
        F.array(
            F.when(
                pages < K.MIN_PAGES,
                F.concat(F.lit("Only "), plural(pages, "page"), F.lit(f" could be read; a score needs at least {K.MIN_PAGES}.")),
            ),
            F.when(
                limited > 0,
                F.concat(
                    F.lit("The site refused "), plural(limited, "request"), F.lit(" as too many, so some checks may read low.")
                ),
            ),
            F.when(
                share > K.MAX_UNVERIFIED_SHARE,
                F.concat(
                    F.col("unverified").cast("string"), F.lit(" of the "), F.col("applicable").cast("string"),
                    F.lit(" checks that apply could not be verified."),
                ),
            ),
        )
    )


def provisional_reasons(checks: DataFrame, coverage: DataFrame) -> DataFrame:
    """``site_key, reasons``; ``coverage``: ``site_key, pages_tested, rate_limited``."""
    totals = site_totals(checks).join(_coverage(coverage), "site_key", "left")
    return _fill(totals).select("site_key", provisional_parts().alias("reasons"))


def _coverage(coverage: DataFrame) -> DataFrame:
    return coverage.select("site_key", "pages_tested", "rate_limited")


def _fill(totals: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return totals.withColumns(
        {"pages_tested": F.coalesce("pages_tested", zero), "rate_limited": F.coalesce("rate_limited", zero)}
    )


def score_report(
    checks: DataFrame,
    coverage: DataFrame,
    caps: DataFrame | None = None,
    answerability: DataFrame | None = None,
) -> DataFrame:
    """Overall score per site with its groups: one aggregation over the checks, then joins of one row per site.

    ``caps``: ``site_key, cap_value, cap_check, cap_reason``. A cap applies only below the raw score.
    """
    rows = site_totals(checks).join(_coverage(coverage), "site_key", "left")
    rows = _fill(rows)
    if caps is None:
        rows = rows.withColumns(
            {"cap_value": F.lit(None).cast("int"), "cap_check": F.lit(None).cast("string"), "cap_reason": F.lit(None).cast("string")}
        )
    else:
        rows = rows.join(caps.select("site_key", "cap_value", "cap_check", "cap_reason"), "site_key", "left")
    if answerability is None:
        rows = rows.withColumns({"state": F.lit("complete"), "reason": F.lit(None).cast("string")})
    else:
        rows = rows.join(answerability.select("site_key", "state", "reason"), "site_key", "left")
        rows = rows.withColumn("state", F.coalesce("state", F.lit("unavailable")))

    rows = rows.withColumns({"raw": percent(F.col("earned"), F.col("possible")), "groups": F.array(*group_structs())})
    capped = F.coalesce(F.col("cap_value") < F.col("raw"), F.lit(False))
    rows = rows.withColumns(
        {
            "capped": capped,
            "score": F.when(capped, F.col("cap_value")).otherwise(F.col("raw")).cast("int"),
            "provisional_reasons": F.when(
                F.col("possible") == 0, F.array(F.lit("None of the checks could run, so there is nothing to score."))
            ).otherwise(provisional_parts()),
        }
    )
    freshness_note = F.get("groups", F.lit(1))["note"]
    reason = F.when(F.col("possible") == 0, "None of the checks could run, so there is no score.").otherwise(
        F.concat_ws(
            " ",
            F.concat(number_text(F.col("earned")), F.lit(" of "), number_text(F.col("possible")), F.lit(" possible points.")),
            F.when(
                F.col("state") == "pending",
                "Answerability is still being tested and will be added when it finishes.",
            ),
            freshness_note,
            F.when(
                F.col("capped"),
                F.concat(F.lit("Held at "), F.col("cap_value").cast("string"), F.lit(" by a cap: "), F.col("cap_reason")),
            ),
        )
    )
    return rows.select(
        "site_key", "score", grade_for(F.col("score")).alias("grade"), "earned", "possible",
        F.when(F.col("capped"), F.struct("cap_value", "cap_check", "cap_reason")).alias("cap"),
        (F.size("provisional_reasons") > 0).alias("provisional"), "provisional_reasons", reason.alias("reason"), "groups",
    )


def overall_score(checks: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """``site_key, earned, possible, score, grade, capped`` without the coverage-dependent parts."""
    rows = site_totals(checks).select("site_key", "earned", "possible")
    raw = percent(F.col("earned"), F.col("possible"))
    if caps is None:
        rows = rows.withColumn("score", raw).withColumn("capped", F.lit(False))
    else:
        rows = rows.join(caps.select("site_key", "cap_value"), "site_key", "left")
        rows = rows.withColumn("capped", F.coalesce(F.col("cap_value") < raw, F.lit(False)))
        rows = rows.withColumn("score", F.when(F.col("capped"), F.col("cap_value")).otherwise(raw).cast("int")).drop("cap_value")
    return rows.withColumn("grade", grade_for(F.col("score")))


def leaderboard(reports: DataFrame) -> DataFrame:
    """Ranks settled scores within one methodology version; provisional ones stay off.

    ``reports``: ``site_key, methodology_version, score, provisional``. Scores are whole numbers from 0 to 100, so
    ranks come from at most 101 counts per version and no window ever holds all sites.
    """
    settled = reports.filter(~F.col("provisional") & F.col("score").isNotNull())
    levels = settled.groupBy("methodology_version", "score").agg(F.count("*").alias("n"))
    above = Window.partitionBy("methodology_version").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.withColumn("rank", F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).drop("n")
    return settled.join(ranks, ["methodology_version", "score"]).select("methodology_version", "rank", "site_key", "score")
