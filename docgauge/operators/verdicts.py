"""Whether links, section anchors and sitemap entries still work, from the fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docgauge import constants as K
from docgauge.functions import html as H, urls as U
from docgauge.functions.numbers import plural
from docgauge.operators.common import native_check, ordered_texts

from docgauge.operators.sampling import anchor_sample, choose_link_targets, pick_evenly
from docgauge.session import Scope, kept

_HEAD_UNRELIABLE = (403, 404, 405, 410, 501)


def link_answers(responses: DataFrame) -> DataFrame:
    """``site_key, url`` with the verdict of the last HEAD, re-checked by the last GET where HEAD cannot be trusted."""
    outcome = F.struct("status", "failure")

    def last(method: str) -> Column:
        mine = F.col("method") == method
        return F.max_by(F.when(mine, outcome), F.when(mine, F.col("fetch_ord")))

    both = responses.groupBy("site_key", "url").agg(last("HEAD").alias("head"), last("GET").alias("get"))
    use_get = F.col("head").isNull() | F.coalesce(F.col("head.status").isin(*_HEAD_UNRELIABLE), F.lit(False))
    return both.select(
        "site_key", "url",
        F.when(use_get, F.col("get")).otherwise(F.col("head")).alias("answer"),
    ).select("site_key", "url", link_state(F.col("answer.status"), F.col("answer.failure")).alias("verdict"))


def link_state(status: Column, failure: Column) -> Column:
    """``struct(state, detail)``: only 404, 410 and an unknown host prove a link broken."""

    def verdict(state: str, detail: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), detail.alias("detail"))

    text = status.cast("string")
    return (
        F.when(failure == "dns", verdict("broken", F.lit("host not found")))
        .when(failure.isNotNull(), verdict("unverified", failure))
        .when(status.isNull(), verdict("unverified", F.lit("other")))
        .when(status.isin(404, 410), verdict("broken", text))
        .when(status < 400, verdict("ok", text))
        .otherwise(verdict("unverified", text))
    )


def link_verdicts(targets: DataFrame, facts: DataFrame, responses: DataFrame, key: str = "url") -> DataFrame:
    """Adds ``verdict`` to link targets: a sampled page is fine as it is, anything else is what the log says."""
    known = facts.select("site_key", "page_key").distinct().withColumn("known", F.lit(True))
    answers = link_answers(responses).withColumnRenamed("url", key)
    keyed = targets.withColumn("page_key", U.page_key(F.col(key)))
    joined = keyed.join(known, ["site_key", "page_key"], "left").join(answers, ["site_key", key], "left")
    sampled = F.struct(F.lit("ok").alias("state"), F.lit("sampled page").alias("detail"))
    missing = F.struct(F.lit("unverified").alias("state"), F.lit("other").alias("detail"))
    verdict = F.when(F.col("known"), sampled).otherwise(F.coalesce("verdict", missing))
    return joined.withColumn("verdict", verdict).drop("known", "page_key")


def anchor_verdicts(
    references: DataFrame, facts: DataFrame, links: DataFrame, responses: DataFrame
) -> DataFrame:
    """Adds ``verdict`` to section references: the page's own ids decide, read from the sample or from the log.

    ``links`` is the output of ``link_verdicts``.
    """
    # pages that share a key (a page and its Markdown twin) are one; the last one counts
    pages = facts.groupBy("site_key", "page_key").agg(F.max_by("anchors", "page_ord").alias("sampled_ids"))
    checked = links.select("site_key", "url", F.col("verdict").alias("link_verdict"))
    wanted = references.select("site_key", "url").distinct()
    bodies = responses.filter(F.col("method") == "GET").join(wanted, ["site_key", "url"], "left_semi")
    bodies = bodies.groupBy("site_key", "url").agg(
        F.max_by(F.struct("status", "failure", F.left("body", F.lit(K.ANCHOR_PAGE_CHARS)).alias("body")), "fetch_ord").alias("page")
    )
    fetched = bodies.select(
        "site_key", "url", F.lit(True).alias("fetched"), F.col("page.status").alias("status"),
        F.col("page.failure").alias("failure"),
        F.coalesce(H.anchor_ids(F.col("page.body")), F.array().cast("array<string>")).alias("fetched_ids"),
    )
    joined = (
        references.withColumn("page_key", U.page_key(F.col("url")))
        .join(pages, ["site_key", "page_key"], "left")
        .join(checked, ["site_key", "url"], "left")
        .join(fetched, ["site_key", "url"], "left")
    )

    def verdict(state: str, detail) -> Column:
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(F.lit(state).alias("state"), detail.alias("detail"))

    def by_ids(ids: str) -> Column:
        return F.when(F.array_contains(F.col(ids), F.col("fragment")), verdict("ok", "section found")).otherwise(
            verdict("broken", "no such section")
        )

    status = F.col("status")
    outcome = (
        F.when(F.col("fragment") == "top", verdict("ok", "top of page"))
        .when(F.col("sampled_ids").isNotNull(), by_ids("sampled_ids"))
        .when(F.col("link_verdict.state") != "ok", F.col("link_verdict"))
        .when(F.col("fetched").isNull(), verdict("unverified", "other"))
        .when(F.col("failure").isNotNull(), verdict("unverified", F.col("failure")))
        .when(status.isin(404, 410), verdict("broken", status.cast("string")))
        .when(status >= 400, verdict("unverified", status.cast("string")))
        .otherwise(by_ids("fetched_ids"))
    )
    return joined.withColumn("verdict", outcome).drop(
        "page_key", "sampled_ids", "link_verdict", "fetched", "status", "failure", "fetched_ids"
    )


def links_and_anchors(
    sites: DataFrame, facts: DataFrame, references: DataFrame, responses: DataFrame, scope: Scope | None = None
) -> DataFrame:
    """The check row per site. ``references`` from ``collect_references``; at most 60 verdicts per site reach it."""
    targets = choose_link_targets(references, sites)
    links = kept(link_verdicts(targets, facts, responses), scope)
    anchors = anchor_verdicts(anchor_sample(references, sites), facts, links, responses)
    entries = links.select(
        "site_key", F.when(F.col("internal"), 0).otherwise(1).alias("kind"), "page_ord", "ref_ord",
        F.col("url").alias("label"), "from_url", "verdict",
    ).unionByName(
        anchors.select(
            "site_key", F.lit(2).alias("kind"), "page_ord", "ref_ord",
            F.concat_ws("#", "url", "fragment").alias("label"), "from_url", "verdict",
        )
    )
    state, is_anchor = F.col("verdict.state"), F.col("kind") == 2
    broken = state == "broken"
    line = F.concat(
        F.col("label"), F.lit(" ("), F.col("verdict.detail"), F.lit(") linked from "), F.col("from_url")
    )
    counts = entries.groupBy("site_key").agg(
        F.count("*").alias("n"),
        F.count_if(state != "unverified").alias("checked"),
        F.count_if(broken).alias("broken"),
        F.count_if(broken & is_anchor).alias("broken_anchors"),
        F.count_if((state != "unverified") & is_anchor).alias("anchors_checked"),
        ordered_texts(F.struct("kind", "page_ord", "ref_ord"), line, broken, 5).alias("evidence"),
    )
    rows = sites.select("site_key").join(counts, "site_key", "left")
    n, checked, bad = F.coalesce("n", F.lit(0)), F.coalesce("checked", F.lit(0)), F.col("broken")
    rate = bad / F.when(checked > 0, checked)
    credit = F.when(checked > 0, (checked - bad) / checked)
    status = (
        F.when(n == 0, "skip")
        .when(checked == 0, "unverified")
        .when(bad == 0, "pass")
        .when(rate <= 0.05, "warn")
        .otherwise("fail")
    )
    left = n - checked
    note = F.when(
        left > 0,
        F.concat(
            F.lit(" "), left.cast("string"), F.lit(" more could not be verified (timeouts or blocked requests) and "),
            F.when(left == 1, "is").otherwise("are"), F.lit(" not counted."),
        ),
    ).otherwise("")
    bad_anchors, anchors_checked = F.col("broken_anchors"), F.col("anchors_checked")
    message = (
        F.when(n == 0, "The sampled pages carry no links to check.")
        .when(
            checked == 0,
            F.concat(
                F.lit("None of the "), n.cast("string"),
                F.lit(" links on the sampled pages could be verified (timeouts, blocked requests or the scan's limits)."),
            ),
        )
        .when(
            bad == 0,
            F.concat(
                F.lit("All "), (checked - anchors_checked).cast("string"), F.lit(" links"),
                F.when(anchors_checked > 0, F.concat(F.lit(" and "), anchors_checked.cast("string"), F.lit(" section anchors"))).otherwise(""),
                F.lit(" checked on the sampled pages work."), note,
            ),
        )
        .otherwise(
            F.concat(
                bad.cast("string"), F.lit(" of "), checked.cast("string"),
                F.lit(" references checked on the sampled pages are broken: "), plural(bad - bad_anchors, "link"),
                F.when(bad_anchors > 0, F.concat(F.lit(" and "), plural(bad_anchors, "section anchor"))).otherwise(""),
                F.lit("."), note,
            )
        )
    )
    fix = F.when(
        bad > 0,
        "Fix or remove broken links, redirect moved pages to their new address and restore or retarget section "
        "anchors: a dead link ends the path an agent follows for context.",
    )
    return native_check(rows, "links-and-anchors", 27, status, credit, message, fix, F.col("evidence"))


def unsampled_sitemap(in_scope: DataFrame, facts: DataFrame) -> DataFrame:
    """Sitemap entries that are not pages of the sample."""
    keyed = in_scope.withColumn("page_key", U.page_key(F.col("loc")))
    return keyed.join(facts.select("site_key", "page_key"), ["site_key", "page_key"], "left_anti").drop("page_key")


def sitemap_live(
    sites: DataFrame, chosen: DataFrame, in_scope: DataFrame, facts: DataFrame, responses: DataFrame
) -> DataFrame:
    """Ten evenly picked unsampled entries per site, checked in the log."""
    rest = unsampled_sitemap(in_scope, facts)
    picked = pick_evenly(rest, ["site_key"], "loc", K.MAX_SITEMAP_PROBES, bounded=True)
    answers = link_answers(responses).withColumnRenamed("url", "loc")
    missing = F.struct(F.lit("unverified").alias("state"), F.lit("other").alias("detail"))
    probed = picked.join(answers, ["site_key", "loc"], "left").withColumn("verdict", F.coalesce("verdict", missing))
    state = F.col("verdict.state")
    line = F.concat(F.col("loc"), F.lit(" ("), F.col("verdict.detail"), F.lit(")"))
    counts = probed.groupBy("site_key").agg(
        F.count("*").alias("probes"),
        F.count_if(state != "unverified").alias("verified"),
        F.count_if(state == "broken").alias("dead"),
        ordered_texts(F.col("loc"), line, state == "broken", 5).alias("evidence"),
    )
    listed = in_scope.groupBy("site_key").agg(F.count("*").alias("listed"))
    rows = (
        sites.select("site_key")
        .join(chosen.select("site_key", "sitemap_url"), "site_key", "left")
        .join(listed, "site_key", "left")
        .join(counts, "site_key", "left")
    )
    nothing = F.col("sitemap_url").isNull() | F.col("listed").isNull()
    probes, verified, dead = F.col("probes"), F.col("verified"), F.col("dead")
    credit = (
        F.when(nothing, None)
        .when(probes.isNull(), F.lit(1.0))
        .when(verified > 0, (verified - dead) / verified)
    )
    status = (
        F.when(nothing, "skip")
        .when(probes.isNull(), "pass")
        .when(verified == 0, "unverified")
        .when(dead == 0, "pass")
        .when(credit >= 0.9, "warn")
        .otherwise("fail")
    )
    message = (
        F.when(nothing, "No sitemap entries for these docs to check.")
        .when(probes.isNull(), "Every sitemap entry for these docs is a page the scan read.")
        .when(
            verified == 0,
            F.concat(F.lit("None of the "), probes.cast("string"), F.lit(" sitemap entries sampled could be verified.")),
        )
        .when(dead == 0, F.concat(F.lit("All "), verified.cast("string"), F.lit(" sitemap entries sampled still exist.")))
        .otherwise(
            F.concat(
                dead.cast("string"), F.lit(" of "), verified.cast("string"),
                F.lit(" sitemap entries sampled no longer exist."),
            )
        )
    )
    fix = F.when(dead > 0, "Remove deleted pages from the sitemap, or redirect them.")
    return native_check(rows, "sitemap-live", 28, status, credit, message, fix, F.col("evidence"))
