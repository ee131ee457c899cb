"""Planning and reading back a crawl: request spacing, budgets, refusals and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docgauge import constants as K
from docgauge.functions.dates import to_date
from docgauge.operators.common import first_n, order_buckets


def crawl_plan(requests: DataFrame, delays: DataFrame | None = None, budget: int = K.REQUEST_BUDGET) -> DataFrame:
    """Start offsets per site: the first ``budget`` requests in order, spaced per origin.

    ``requests``: ``site_key, origin, fetch_ord, url``; ``delays``: ``origin, crawl_delay_ms``. The budget is applied
    before anything is ranked per origin, so every window is bounded by it.
    """
    kept = first_n(requests, ["site_key"], ["fetch_ord"], budget)
    if delays is not None:
        kept = kept.join(delays, "origin", "left")
        spacing = F.greatest(F.lit(float(K.MIN_INTERVAL_MS)), F.coalesce("crawl_delay_ms", F.lit(0.0)))
    else:
        spacing = F.lit(float(K.MIN_INTERVAL_MS))
    place = F.row_number().over(Window.partitionBy("site_key", "origin").orderBy("fetch_ord")) - 1
    return kept.select(
        "site_key", "origin", "fetch_ord", "url", (place * spacing).cast("bigint").alias("start_ms")
    )


def retry_after_ms(value: Column, now: Column) -> Column:
    """Seconds or an HTTP date; null when absent or unusable."""
    trimmed = F.trim(value)
    at = to_date(trimmed)
    return F.when(trimmed.rlike(r"^\d+$"), trimmed.try_cast("bigint") * 1000).when(
        at.isNotNull(), F.greatest(F.unix_millis(at) - F.unix_millis(now), F.lit(0))
    )


def retry_wait_ms(value: Column, attempt: Column, now: Column) -> Column:
    """The wait a refusing site asked for, otherwise one second doubling per attempt; zero is not taken literally."""
    asked = retry_after_ms(value, now)
    return F.when(asked > 0, asked).otherwise((F.lit(K.REFUSAL_BACKOFF_MS) * F.pow(F.lit(2), attempt)).cast("bigint"))


def spacing_after(refusals: Column) -> Column:
    """Spacing after the n-th refusal: one second, doubling to four."""
    doubled = (F.lit(K.REFUSED_INTERVAL_MS) * F.pow(F.lit(2), F.least(refusals, F.lit(8)) - 1)).cast("int")
    return F.when(refusals > 0, F.least(F.lit(K.MAX_REFUSED_INTERVAL_MS), doubled)).otherwise(F.lit(K.MIN_INTERVAL_MS))


def refusal_backoff(log: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """Adds ``refusals``, an origin's refused answers up to and with this one, and ``spacing_ms`` to fetches.

    ``log``: ``origin, fetched_at, fetch_ord, status`` and more. Histories are cut into buckets in order of time; refusals are counted in
    each, the sums of the earlier ones are carried over, and only within a bucket does a window run. So an origin with most of the log is
    spread like any other. Rows of one time and ordinal count each other.
    """
    refused = F.coalesce(F.col("status").isin(429, 503), F.lit(False)).cast("int")
    placed = order_buckets(log.withColumn("__refused", refused), ["origin"], F.struct("fetched_at", "fetch_ord"), per_bucket=per_bucket)
    sums = placed.groupBy("origin", "__bucket").agg(F.sum("__refused").alias("__n"))
    carried = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy("origin").orderBy("__bucket")) - F.col("__n")).drop("__n")
    here = F.sum("__refused").over(Window.partitionBy("origin", "__bucket").orderBy("fetched_at", "fetch_ord"))
    rows = placed.join(carried, ["origin", "__bucket"]).withColumn("refusals", F.col("__before") + here)
    return rows.withColumn("spacing_ms", spacing_after(F.col("refusals"))).select(*log.columns, "refusals", "spacing_ms")


def fetch_stats(log: DataFrame) -> DataFrame:
    """Counters per site over ``site_key, url, attempt, status, failure``.

    A refused attempt (429, 503) followed by another one was waited out; a 429 on the last attempt stayed refused.
    """
    status, failure = F.col("status"), F.col("failure")
    per_request = log.groupBy("site_key", "request_id").agg(
        F.count_if(failure.isNull() | ~failure.isin("robots", "robots_unreachable", "budget", "deadline", "blocked")).alias("sent"),
        F.bool_or(F.coalesce(failure.isin("robots", "robots_unreachable"), F.lit(False))).alias("robots_blocked"),
        F.count_if(F.coalesce(status.isin(429, 503), F.lit(False))).alias("refused"),
        F.max_by(F.struct("status"), "attempt").alias("last"),
    )
    last = F.coalesce(F.col("last.status"), F.lit(0))
    return per_request.groupBy("site_key").agg(
        F.sum("sent").alias("requests"),
        F.count_if("robots_blocked").alias("robots_blocked"),
        F.sum(F.col("refused") - last.isin(429, 503).cast("int")).alias("retry_after_waits"),
        F.count_if(last == 429).alias("rate_limited"),
    )


def coverage(sample: DataFrame, stats: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages discovered and tested, discovery sources and request counters per site.

    ``sample`` from ``page_sample``; ``sources``: ``site_key, source``.
    """
    pages = sample.groupBy("site_key").agg(
        F.max("total_pages").alias("pages_discovered"), F.count("*").alias("pages_tested")
    )
    found = sources.groupBy("site_key").agg(F.sort_array(F.collect_set("source")).alias("discovery_sources"))
    return pages.join(stats.select("site_key", "requests", "rate_limited"), "site_key", "left").join(found, "site_key", "left")


def limitations(
    sites: DataFrame, coverage_rows: DataFrame, stats: DataFrame, checks: DataFrame, scores: DataFrame
) -> DataFrame:
    """``site_key, limitations``: what a reader of the report should know about its reach."""
    unverified = checks.groupBy("site_key").agg(F.count_if(F.col("status") == "unverified").alias("unverified_checks"))
    rows = (
        sites.select("site_key", F.coalesce("hash_routed", F.lit(False)).alias("hash_routed"))
        .join(coverage_rows.select("site_key", "pages_tested"), "site_key", "left")
        .join(stats.select("site_key", "robots_blocked"), "site_key", "left")
        .join(unverified, "site_key", "left")
        .join(scores.select("site_key", "provisional", "provisional_reasons"), "site_key", "left")
    )
    pages, blocked = F.coalesce("pages_tested", F.lit(0)), F.coalesce("robots_blocked", F.lit(0))

    def s(n: Column) -> Column:
        return F.when(n == 1, "").otherwise("s")

    notes = F.array_compact(
        F.array(
            F.concat(
                F.lit("Based on "), pages.cast("string"), F.lit(" sampled page"), s(pages),
                F.lit(", chosen deterministically from the sitemap and llms.txt. Pages outside the sample were not read."),
            ),
            F.lit("Pages were fetched without running JavaScript, the way most AI agents read the web."),
            F.when(
                F.col("hash_routed"),
                'The submitted URL routes content after "#/", which agents cannot follow, so only the landing page was '
                "reachable.",
            ),
            F.when(
                blocked > 0,
                F.concat(
                    F.lit("robots.txt stopped the scanner from reading "), blocked.cast("string"), F.lit(" URL"), s(blocked),
                    F.lit("; checks that needed them are unverified."),
                ),
            ),
            F.when(
                F.col("unverified_checks") > 0,
                "Some checks could not be verified (a timeout, a blocked request or a scan limit); they are left out of "
                "the score rather than counted as failures.",
            ),
            provisional_line(),
        )
    )
    return rows.select("site_key", notes.alias("limitations"))


def provisional_line() -> Column:
    return F.when(
        F.col("provisional"),
        F.concat(F.lit("The score is provisional: "), F.array_join("provisional_reasons", " ")),
    )


def final_limitations(technical: DataFrame, scores: DataFrame, answerability: DataFrame) -> DataFrame:
    """The technical notes with the provisional line restated for the final score, and why answers are missing."""
    rows = technical.join(scores.select("site_key", "provisional", "provisional_reasons"), "site_key", "left").join(
        answerability.select("site_key", "state", F.col("reason").alias("why")), "site_key", "left"
    )
    kept = F.filter("limitations", lambda note: ~F.startswith(note, F.lit("The score is provisional:")))
    extra = F.array_compact(F.array(provisional_line(), F.when(F.col("state") != "complete", F.col("why"))))
    return rows.select("site_key", F.concat(kept, extra).alias("limitations"))
