"""Reports: what a run found, scored, explained and nested, for the technical stage and again when answers have arrived."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from docgauge.operators import answers as A, crawl, fixes as X, report as R, scoring
from docgauge.session import Scope, stored

_ENTRIES = "site_key string, question_ord bigint, question string, source_url string, verdict string, reason string"


@dataclass
class Findings:
    """What the technical stage hands on. ``sites``: ``site_key, scope_root, name, report_url, first_page, started_on`` and whatever
    else a report shows of its site; ``coverage``: ``site_key, pages_tested, rate_limited`` and more; ``notes``: ``site_key, limitations``."""

    sites: DataFrame
    checks: DataFrame
    extras: DataFrame
    coverage: DataFrame
    notes: DataFrame
    caps: DataFrame | None = None


def finalize_report(
    technical_checks: DataFrame,
    rollup: DataFrame,
    entries: DataFrame,
    coverage: DataFrame,
    caps: DataFrame | None = None,
    scope: Scope | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replaces the answer checks, rescores and re-ranks the fixes. Returns ``(checks, scores, fixes)``."""
    checks = technical_checks.filter(F.col("group") != "answerability").unionByName(A.answerability_checks(rollup))
    checks = stored(checks, scope)
    scores = stored(scoring.score_report(checks, coverage, caps, rollup), scope)
    fixes = stored(X.answer_fix(X.top_fixes(checks), checks, rollup, entries), scope)
    return checks, scores, fixes


def _assembled(
    found: Findings, checks: DataFrame, scores: DataFrame, fixes: DataFrame, notes: DataFrame, state: DataFrame, entries: DataFrame, stage: str
) -> DataFrame:
    tested = found.coverage.select("site_key", F.col("pages_tested").cast("int").alias("pages_tested"))
    sites = found.sites.join(tested, "site_key", "left").withColumn("pages_tested", F.coalesce("pages_tested", F.lit(0)))
    told = sites.join(state.select("site_key", F.col("state").alias("answer_state")), "site_key", "left")
    prompts = R.fix_prompt(told, checks, found.extras, entries, fixes, scores)
    has_answers = entries if "answer" in entries.columns else None
    report = R.nested_report(sites, checks, found.extras, fixes, scores, has_answers)
    answers = state.select("site_key", F.struct(*[c for c in state.columns if c != "site_key"]).alias("answerability"))
    return (
        report.join(notes, "site_key", "left").join(prompts, "site_key", "left").join(answers, "site_key", "left").withColumn("stage", F.lit(stage))
    )


def technical_report(found: Findings, state: DataFrame, scope: Scope | None = None) -> DataFrame:
    """One nested row per site before any answer. ``state``: ``site_key, state, reason`` of answerability: pending or unavailable."""
    checks = found.checks
    scores = stored(scoring.score_report(checks, found.coverage, found.caps, state), scope)
    nothing = checks.sparkSession.createDataFrame([], _ENTRIES)
    return _assembled(found, checks, scores, X.top_fixes(checks), found.notes, state, nothing, "technical")


def final_report(found: Findings, rollup: DataFrame, entries: DataFrame, scope: Scope | None = None) -> DataFrame:
    """One nested row per site with its answers: checks replaced, rescored, fixes re-ranked, notes restated, missed questions in the fix
    list. ``rollup`` from ``answerability_rollup``, ``entries`` from ``transcript``; only complete runs show their entries."""
    complete = rollup.filter(F.col("state") == "complete").select("site_key")
    rollup, entries = stored(rollup, scope), stored(entries.join(complete, "site_key", "left_semi"), scope)
    checks, scores, fixes = finalize_report(found.checks, rollup, entries, found.coverage, found.caps, scope)
    return _assembled(found, checks, scores, fixes, crawl.final_limitations(found.notes, scores, rollup), rollup, entries, "final")
