"""Watching a fetch log as it grows: counters per window, and reports refreshed as results arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from docgauge.operators import scoring
from docgauge.sources.sinks import ReportStore


def stream_fetch_monitor(log: DataFrame, window: str = "10 minutes", lateness: str = "5 minutes") -> DataFrame:
    """Requests, refusals and robots blocks per site and window; rows later than the watermark are dropped.

    ``log``: a streaming (or static) table with ``site_key, fetched_at, status, failure``.
    """
    status, failure = F.col("status"), F.col("failure")
    counted = (
        log.withWatermark("fetched_at", lateness)
        .groupBy(F.window("fetched_at", window), "site_key")
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.coalesce(status == 429, F.lit(False))).alias("rate_limited"),
            F.count_if(F.coalesce(failure.isin("robots", "robots_unreachable"), F.lit(False))).alias("robots_blocked"),
            F.count_if(F.coalesce(failure.isin("budget", "deadline"), F.lit(False))).alias("cut_off"),
        )
    )
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "site_key", "requests",
        "rate_limited", "robots_blocked", "cut_off",
    )


def refresh_touched(
    arrived: DataFrame,
    all_checks: DataFrame,
    coverage: DataFrame,
    state: DataFrame | None = None,
    caps: DataFrame | None = None,
) -> DataFrame:
    """Rescored reports of the sites that new results touch; other sites are not read past the join."""
    touched = arrived.select("site_key").distinct()
    checks = all_checks.join(touched, "site_key", "left_semi")
    return scoring.score_report(checks, coverage.join(touched, "site_key", "left_semi"), caps, state)


def stream_report_upsert(
    arriving: DataFrame,
    load_checks: Callable[[], DataFrame],
    load_coverage: Callable[[], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    state: DataFrame | None = None,
    caps: DataFrame | None = None,
) -> StreamingQuery:
    """Each batch of new check results rescored with everything known about the touched sites.

    ``write`` gets the reports and the batch number; writing under the batch number makes a replayed batch harmless.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write(refresh_touched(rows, load_checks(), load_coverage(), state, caps), number)

    return (
        arriving.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_into(store: ReportStore, version: str, first_run: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``write`` for ``stream_report_upsert``: batch n becomes run ``first_run`` + n of a report store. A batch that is run again, by
    a restart or from a new checkpoint, replaces its own run, and readers see the latest run of each site."""

    def write(reports: DataFrame, number: int) -> None:
        store.write(reports, version, first_run + number)

    return write
