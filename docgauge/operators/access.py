"""Whether crawlers may read the docs, whether the sitemap covers them, and whether pages are dated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docgauge import constants as K
from docgauge.functions import dates as D, urls as U
from docgauge.functions.numbers import list_of, status_for_credit
from docgauge.operators.common import first_per, native_check, ordered_texts
from docgauge.sources.llms import llms_links
from docgauge.sources.robots import robots_access

# Parts of a site whose pages are put in order on their own.
_PARTS = 64


def crawler_permissions(sites: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """Share of the six crawlers that honour robots.txt and may read the scope."""
    agents = [*K.CRAWLERS_HONOURING, *K.CRAWLERS_IGNORING, *K.CRAWLERS_TRAINING]
    targets = sites.select(
        "site_key",
        F.regexp_extract("scope_root", r"^([a-z]+://[^/]+)", 1).alias("origin"),
        F.concat(F.regexp_extract("scope_root", r"^[a-z]+://[^/]+(.*)$", 1), F.lit("/")).alias("path"),
    )
    access = robots_access(targets, files, rules, agents)
    position = F.array_position(F.array(*[F.lit(a) for a in agents]), F.col("agent"))
    refused = ~F.coalesce("allowed", F.lit(True))

    def blocked(names: tuple[str, ...]) -> Column:
        return ordered_texts(position, F.col("agent"), refused & F.col("agent").isin(*names), len(names))

    rows = access.groupBy("site_key", "origin").agg(
        F.bool_or(F.col("state") == "unreachable").alias("unreachable"),
        blocked(K.CRAWLERS_HONOURING).alias("blocked"),
        blocked(K.CRAWLERS_IGNORING).alias("ignoring"),
        blocked(K.CRAWLERS_TRAINING).alias("training"),
    )
    total = len(K.CRAWLERS_HONOURING)
    n = F.size("blocked")
    credit = F.when(~F.col("unreachable"), (F.lit(total) - n) / F.lit(total))
    status = F.when(F.col("unreachable"), "unverified").otherwise(status_for_credit(credit, 1.0, 0.01))

    def note(names: str, why: str) -> Column:
        return F.when(
            F.size(names) > 0,
            F.concat(F.lit(" Also blocked: "), list_of(F.col(names)), F.lit(f" ({why}).")),
        ).otherwise("")

    notes = F.concat(
        note("ignoring", "its provider says robots.txt may not apply to user requests, so this is reported, not scored"),
        note("training", "training crawlers; opting out of training is a policy choice, not scored"),
    )
    everyone = list_of(F.array(*[F.lit(a) for a in K.CRAWLERS_HONOURING]))
    message = (
        F.when(
            F.col("unreachable"),
            F.concat("origin", F.lit("/robots.txt could not be read, so crawler permissions could not be verified.")),
        )
        .when(n == 0, F.concat(F.lit("robots.txt lets "), everyone, F.lit(" read the docs."), notes))
        .otherwise(
            F.concat(
                F.lit("robots.txt blocks "), list_of(F.col("blocked")), F.lit(" from the docs ("), n.cast("string"),
                F.lit(f" of the {total} crawlers that honour it)."), notes,
            )
        )
    )
    fix = F.when(
        F.col("unreachable"), "Make sure robots.txt answers with 200 or 404; an error tells crawlers to stay away."
    ).when(
        n > 0,
        F.concat(F.lit("Allow "), list_of(F.col("blocked")), F.lit(" for the documentation paths in robots.txt.")),
    )
    return native_check(rows, "crawler-permissions", 24, status, credit, message, fix)


def discovered_pages(sites: DataFrame, facts: DataFrame, llms_txt: DataFrame, links: DataFrame) -> DataFrame:
    """Pages found without the sitemap: the sample, then llms.txt links, then page links; one row per document.

    ``links``: ``site_key, page_ord, ref_ord, url``. Returns ``site_key, page_key, url, found_ord``.
    """
    zero = F.lit(0)
    found = (
        facts.select("site_key", F.struct(F.lit(0).alias("k"), F.col("page_ord").alias("p"), zero.alias("r")).alias("found_ord"), "url")
        .unionByName(
            llms_links(llms_txt).select(
                "site_key", F.struct(F.lit(1).alias("k"), F.col("link_ord").alias("p"), zero.alias("r")).alias("found_ord"),
                F.col("link").alias("url"),
            )
        )
        .unionByName(
            links.select(
                "site_key", F.struct(F.lit(2).alias("k"), F.col("page_ord").alias("p"), F.col("ref_ord").alias("r")).alias("found_ord"),
                "url",
            )
        )
    )
    roots = U.with_url(sites.select("site_key", "scope_root"), "scope_root", "r_").select("site_key", "r_host", "r_path")
    located = U.with_url(found.join(roots, "site_key"), "url", "u_")
    inside = located.filter(
        F.col("u_valid") & U.in_scope(F.col("u_host"), F.col("u_path"), F.col("r_host"), F.col("r_path"))
    )
    keyed = inside.select("site_key", "found_ord", "url", U.page_key(F.col("url")).alias("page_key"))
    return first_per(keyed, ["site_key", "page_key"], ["found_ord"])


def sitemap_missing(discovered: DataFrame, in_scope: DataFrame) -> DataFrame:
    """Discovered documents the sitemap does not list."""
    listed = in_scope.select("site_key", U.page_key(F.col("loc")).alias("page_key"))
    return discovered.join(listed, ["site_key", "page_key"], "left_anti")


def sitemap_coverage(sites: DataFrame, discovered: DataFrame, chosen: DataFrame, in_scope: DataFrame) -> DataFrame:
    listed = in_scope.select("site_key", U.page_key(F.col("loc")).alias("page_key")).distinct()
    marked = discovered.join(listed.withColumn("listed", F.lit(True)), ["site_key", "page_key"], "left")
    # Pages are found once for both the counts and the evidence, of which parts of a site gather their first five: a site may miss any number.
    missed = F.col("listed").isNull()
    part = Window.partitionBy("site_key", F.pmod(F.xxhash64("page_key"), F.lit(_PARTS)), missed)
    placed = marked.withColumn("early", missed & (F.row_number().over(part.orderBy("found_ord")) <= 5))
    totals = placed.groupBy("site_key").agg(
        F.count("*").alias("discovered"), F.count_if(missed).alias("missing"),
        ordered_texts(F.col("found_ord"), F.col("url"), F.col("early"), 5).alias("evidence"),
    )
    rows = (
        sites.select("site_key")
        .join(totals, "site_key", "left")
        .join(chosen.select("site_key", "sitemap_url"), "site_key", "left")
    )
    n, missing, url = F.coalesce("discovered", F.lit(0)), F.col("missing"), F.col("sitemap_url")
    credit = F.when(n == 0, None).when(url.isNull(), F.lit(0.0)).otherwise((n - missing) / F.when(n > 0, n))
    status = F.when(n == 0, "skip").when(url.isNull(), "fail").otherwise(status_for_credit(credit, 0.9, 0.5))
    message = (
        F.when(n == 0, "No docs pages were found on their own to compare with the sitemap.")
        .when(
            url.isNull(),
            F.concat(
                F.lit("No sitemap was found for these docs, so none of the "), n.cast("string"),
                F.lit(" pages found through llms.txt and page links is listed in one."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("The sitemap at "), url, F.lit(" lists "), (n - missing).cast("string"), F.lit(" of the "),
                n.cast("string"), F.lit(" docs pages found through llms.txt and page links."),
            )
        )
    )
    fix = F.when((n > 0) & url.isNull(), "Publish a sitemap.xml listing every documentation page and name it in robots.txt.").when(
        missing > 0, "Generate the sitemap from the same source as the docs, so every page is listed."
    )
    evidence = F.when(url.isNotNull() & (missing > 0), F.col("evidence"))
    return native_check(rows, "sitemap-coverage", 25, status, credit, message, fix, evidence)


def sitemap_lastmod(facts: DataFrame, in_scope: DataFrame) -> DataFrame:
    """Adds ``dated``: ``page``, ``sitemap`` (no date on the page, one in the sitemap) or ``none``."""
    # The last entry of a document wins when it is listed twice.
    lastmods = in_scope.groupBy("site_key", U.page_key(F.col("loc")).alias("page_key")).agg(
        F.max_by(F.struct("lastmod"), "entry_ord").alias("entry")
    )
    joined = facts.select("site_key", "page_ord", "url", "page_key", "declared_at").join(
        lastmods, ["site_key", "page_key"], "left"
    )
    listed = D.to_date(F.col("entry.lastmod"))
    dated = F.when(F.col("declared_at").isNotNull(), "page").when(listed.isNotNull(), "sitemap").otherwise("none")
    return joined.select(
        "site_key", "page_ord", "url", dated.alias("dated"),
        F.coalesce("declared_at", listed).alias("updated_at"),
    )


def update_info(sites: DataFrame, facts: DataFrame, in_scope: DataFrame) -> DataFrame:
    counts = sitemap_lastmod(facts, in_scope).groupBy("site_key").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("dated") == "page").alias("on_page"),
        F.count_if(F.col("dated") == "sitemap").alias("in_sitemap"),
    )
    rows = sites.select("site_key").join(counts, "site_key", "left")
    pages, on_page, in_sitemap = F.col("pages"), F.col("on_page"), F.col("in_sitemap")
    credit = (on_page + in_sitemap * 0.5) / pages
    status = F.when(pages.isNull(), "skip").otherwise(status_for_credit(credit, 0.8, 0.5))
    extra = F.when(
        in_sitemap > 0,
        F.concat(
            F.lit(", and "), in_sitemap.cast("string"), F.lit(" more ha"), F.when(in_sitemap == 1, "s").otherwise("ve"),
            F.lit(" a date only in the sitemap"),
        ),
    ).otherwise("")
    message = F.when(pages.isNull(), "No pages could be read.").otherwise(
        F.concat(
            on_page.cast("string"), F.lit(" of "), pages.cast("string"),
            F.lit(" sampled pages state when they were last changed"), extra, F.lit("."),
        )
    )
    fix = F.when(
        credit < 0.8,
        "Publish a last-modified date on every page: as article:modified_time or dateModified, a visible "
        '"Last updated" line, or a Last-Modified header.',
    )
    return native_check(rows, "update-info", 26, status, credit, message, fix)
