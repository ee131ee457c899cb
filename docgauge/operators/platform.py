"""Names the platform a site runs on from weighted page signals; it explains findings and never changes a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docgauge import constants as K
from docgauge.functions import html as H
from docgauge.functions.numbers import rounded
from docgauge.operators.common import numbered


def _matches(kind: str, pattern: str) -> Column:
    html, url = F.col("html"), F.col("url")
    if kind == "generator":
        return F.coalesce(F.trim("generator").rlike(pattern), F.lit(False))
    if kind == "meta":
        return H.has_meta(F.col("metas"), pattern)
    if kind == "html":
        return F.contains(html, F.lit(pattern))
    if kind == "selector":
        return html.rlike(H.selector_rlike(pattern))
    return url.rlike(pattern)


def platform_signals_match(pages: DataFrame, profiles=K.PLATFORM_SIGNALS) -> DataFrame:
    """``site_key, platform_ord, signal_ord, weight`` of the signals found on any page of a site.

    The signal list is configuration, so it becomes one expression per page rather than a join: each page is read
    once and emits only its hits.
    """
    pages = pages.select("site_key", "url", "html", H.meta_values(F.col("html")).alias("metas")).filter(F.col("html") != "")
    pages = pages.withColumn("generator", H.meta_value(F.col("metas"), "name", "generator"))
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    _matches(kind, pattern),
                    F.struct(
                        F.lit(p).alias("platform_ord"), F.lit(s).alias("signal_ord"), F.lit(weight).alias("weight")
                    ),
                )
                for p, (_, _, _, signals) in enumerate(profiles)
                for s, (kind, pattern, weight) in enumerate(signals)
            ]
        )
    )
    return numbered(pages, ["site_key"], hits, "__pos", "hit").select("site_key", "hit.*").distinct()


def platform_detect(sites: DataFrame, matched: DataFrame, profiles=K.PLATFORM_SIGNALS) -> DataFrame:
    """``site_key, platform, name, confidence, help_center``: the best share of signal weight, first on a tie.

    A platform needs two signals or one decisive one, and a third of its weight.
    """
    scored = matched.groupBy("site_key", "platform_ord").agg(
        F.count("*").alias("signals"), F.sum("weight").alias("weight"), F.max("weight").alias("strongest")
    )
    totals = F.array(*[F.lit(float(sum(w for _, _, w in signals))) for _, _, _, signals in profiles])
    confidence = F.col("weight") / F.get(totals, F.col("platform_ord"))
    usable = scored.withColumn("confidence", confidence).filter(
        ((F.col("signals") >= 2) | (F.col("strongest") >= K.DECISIVE_WEIGHT))
        & (F.col("confidence") >= K.MIN_PLATFORM_CONFIDENCE)
    )
    best = usable.groupBy("site_key").agg(
        F.max(F.struct("confidence", (-F.col("platform_ord")).alias("neg_ord"))).alias("best")
    )
    ordinal = -F.col("best.neg_ord")

    def named(values: list, default) -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), ordinal), F.lit(default))

    return sites.select("site_key").join(best, "site_key", "left").select(
        "site_key",
        named([p[0] for p in profiles], "unknown").alias("platform"),
        named([p[1] for p in profiles], "Unknown").alias("name"),
        F.coalesce(rounded(F.col("best.confidence"), 100), F.lit(0.0)).alias("confidence"),
        named([p[2] for p in profiles], False).alias("help_center"),
    )


def settle_profile(sites: DataFrame, detected: DataFrame) -> DataFrame:
    """A help-centre platform overrides an inferred profile, never a chosen one (``profile_chosen``)."""
    chosen = F.coalesce(F.col("profile_chosen"), F.lit(False)) if "profile_chosen" in sites.columns else F.lit(False)
    joined = sites.join(detected.select("site_key", "help_center"), "site_key", "left")
    profile = F.when(~chosen & F.coalesce("help_center", F.lit(False)), "help-center").otherwise(F.col("profile"))
    return joined.withColumn("profile", profile).drop("help_center")
