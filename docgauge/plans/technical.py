"""The technical stage: captured tables in, check rows, scores and what a report needs of its site out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docgauge.operators import access, agentdocs, apispec, crawl, identity, pages as P, platform, protocols, sampling, scoring, verdicts
from docgauge.operators.fixes import top_fixes
from docgauge.plans.final import Findings
from docgauge.session import Scope, stored
from docgauge.sources import robots, sitemaps, specs


@dataclass
class Captured:
    """Inputs of a run. ``responses`` is the fetch log; the rest are views of it or tables beside it."""

    sites: DataFrame  # site_key, scope_root, domain, profile; may have profile_chosen, hash_routed
    pages: DataFrame  # site_key, page_ord, url, html, last_modified
    responses: DataFrame  # the fetch log
    robots: DataFrame  # origin, status, body
    llms_txt: DataFrame  # site_key, url, content
    suffixes: DataFrame  # suffix, private
    results: DataFrame | None = None  # agent-docs results, one row per site and check
    cutoffs: DataFrame | None = None  # site_key, id, cut_off: checks that a limit or robots.txt cut short
    diagnostics: DataFrame | None = None  # site_key, id
    sampled: DataFrame | None = None  # site_key, page_ord, url, total_pages: pages chosen; without it all pages found


@dataclass
class Technical:
    sites: DataFrame
    facts: DataFrame
    checks: DataFrame
    extras: DataFrame
    platforms: DataFrame
    fixes: DataFrame
    coverage: DataFrame
    stats: DataFrame
    caps: DataFrame | None
    names: DataFrame


def attempts(responses: DataFrame) -> DataFrame:
    """The fetch log with the request that each row belongs to and the row's place among its attempts, for ``fetch_stats``."""
    request = F.concat_ws(" ", "method", F.coalesce("accept", F.lit("")), "url") if "accept" in responses.columns else F.concat_ws(" ", "method", "url")
    return responses.select("site_key", request.alias("request_id"), F.col("fetch_ord").alias("attempt"), "status", "failure")


def technical_stage(captured: Captured, now: Column | None = None, scope: Scope | None = None) -> Technical:
    """All checks of every site.

    Pages are the sample, or what the sitemap offers where too few were found. What several checks read, such as page facts and collected
    references, is stored in ``scope``, which whoever owns it releases once the reports are written. Without a scope everything is one
    lazy plan, which is large.
    """
    log = captured.responses
    gets = log.filter((F.col("method") == "GET"))
    documents = gets.filter((F.col("status") == 200) & F.col("failure").isNull()).select("url", "body").dropDuplicates(["url"])
    files = robots.robots_file_state(captured.robots)
    rules = robots.robots_rules(files)
    chosen, in_scope = sitemaps.choose_scope_sitemap(captured.sites, robots.robots_sitemaps(files), documents)
    chosen, in_scope = stored(chosen, scope), stored(in_scope, scope)

    found = captured.sampled
    if found is None:
        totals = captured.pages.groupBy("site_key").agg(F.count("*").alias("total_pages"))
        found = captured.pages.select("site_key", "page_ord", "url").join(totals, "site_key")
    sample = stored(sampling.page_sample(found, in_scope), scope)
    facts = stored(P.page_facts(P.page_set(captured.pages, sample), now), scope)
    references = P.content_references(facts)
    collected = stored(P.collect_references(references), scope)
    links = stored(P.content_links(references), scope)

    detected = stored(platform.platform_detect(captured.sites, platform.platform_signals_match(captured.pages)), scope)
    sites = stored(platform.settle_profile(captured.sites, detected), scope)

    mentions = stored(P.endpoint_mentions(facts), scope)
    candidates = specs.spec_candidates(sites, captured.llms_txt, links)
    answers = gets.select("url", "status", "truncated", "body", "final_url").dropDuplicates(["url"])
    spec, operations, bases = (stored(part, scope) for part in specs.load_spec(candidates, answers))
    matched = stored(apispec.spec_match(mentions, operations, bases), scope)

    discovered = access.discovered_pages(sites, facts, captured.llms_txt, links)
    checks = (
        access.crawler_permissions(sites, files, rules)
        .unionByName(access.sitemap_coverage(sites, discovered, chosen, in_scope))
        .unionByName(access.update_info(sites, facts, in_scope))
        .unionByName(verdicts.links_and_anchors(sites, facts, collected, log))
        .unionByName(verdicts.sitemap_live(sites, chosen, in_scope, facts, log))
        .unionByName(apispec.api_spec_match(sites, spec, mentions, matched))
        .unionByName(
            apispec.deprecation_notices(sites, spec, operations, apispec.deprecated_uses(mentions, matched))
        )
    )
    caps = None
    if captured.results is not None:
        results = agentdocs.check_dependencies(captured.results)
        if captured.cutoffs is not None:
            results = agentdocs.cutoff_reclass(results, captured.cutoffs)
        results = stored(results, scope)
        checks = agentdocs.afdocs_checks(results).unionByName(checks)
        if captured.diagnostics is not None:
            caps = stored(agentdocs.afdocs_cap(results, captured.diagnostics), scope)
    # A few dozen small rows per site that scores, fixes and reports all read.
    checks = stored(checks, scope)
    answered = gets.select("url", "status", "content_type", "headers", "body", "truncated", "final_url").dropDuplicates(["url"])
    extras = stored(protocols.additional_checks(sites, captured.llms_txt, answered, captured.suffixes), scope)

    stats = stored(crawl.fetch_stats(attempts(log)), scope)
    sources = in_scope.select("site_key").distinct().withColumn("source", F.lit("sitemap")).unionByName(
        captured.llms_txt.select("site_key").distinct().withColumn("source", F.lit("llms.txt"))
    )
    names = stored(P.site_name(facts, identity.registrable(captured.sites, "domain", captured.suffixes)), scope)
    coverage = stored(crawl.coverage(sample, stats, sources), scope)
    return Technical(sites, facts, checks, extras, detected, top_fixes(checks), coverage, stats, caps, names)


def technical_findings(stage: Technical, report_url: str, started_on: str, state: DataFrame | None = None, scope: Scope | None = None) -> Findings:
    """What a report needs of the stage. ``report_url``: address of a report with ``{site}`` for the site; ``state`` as in ``technical_report``."""
    first = stage.facts.groupBy("site_key").agg(F.min_by("url", "page_ord").alias("first_page"))
    names = stage.names.select("site_key", "name", "title")
    address = F.replace(F.lit(report_url), F.lit("{site}"), F.col("site_key"))
    shown = stage.sites.join(first, "site_key", "left").join(names, "site_key", "left")
    shown = shown.join(stage.platforms.select("site_key", "platform", F.col("confidence").alias("platform_confidence")), "site_key", "left")
    more = stage.coverage.select("site_key", "pages_discovered", "requests", "discovery_sources")
    shown = shown.join(more, "site_key", "left").withColumns({"report_url": address, "started_on": F.lit(started_on)})
    scores = scoring.score_report(stage.checks, stage.coverage, stage.caps, state)
    sites = stage.sites if "hash_routed" in stage.sites.columns else stage.sites.withColumn("hash_routed", F.lit(False))
    notes = crawl.limitations(sites, stage.coverage, stage.stats, stage.checks, scores)
    return Findings(stored(shown, scope), stage.checks, stage.extras, stage.coverage, stored(notes, scope), stage.caps)


def technical_scores(stage: Technical, coverage: DataFrame | None = None, caps: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    return scoring.score_report(stage.checks, stage.coverage if coverage is None else coverage, stage.caps if caps is None else caps, state)
