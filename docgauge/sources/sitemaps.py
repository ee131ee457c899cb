"""Sitemap documents: entries, index expansion and the sitemap that covers a site's scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docgauge import constants as K
from docgauge.functions import urls as U
from docgauge.operators.common import first_n, first_per, numbered
from docgauge.session import Scope, kept


def decode_xml(value: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def parsed_documents(documents: DataFrame) -> DataFrame:
    """Only bodies that are a url set or an index. ``documents``: ``url, body`` of 200 answers."""
    return documents.filter(F.col("body").rlike(r"<(urlset|sitemapindex)[\s>]"))


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """``url, ord, loc, lastmod`` of the ``<url>`` blocks that have a location, 5,000 of these per document."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    found = F.slice(F.filter(blocks, lambda b: b.rlike(r"(?i)<loc>\s*[^<\s]+\s*</loc>")), 1, K.MAX_SITEMAP_ENTRIES)
    rows = numbered(parsed_documents(documents), ["url"], found, "ord", "block")
    return rows.select(
        "url", "ord",
        decode_xml(F.regexp_extract("block", r"(?i)<loc>\s*([^<\s]+)\s*</loc>", 1)).alias("loc"),
        F.nullif(F.regexp_extract("block", r"(?i)<lastmod>\s*([^<\s]+)\s*</lastmod>", 1), F.lit("")).alias("lastmod"),
    )


def sitemap_children(documents: DataFrame) -> DataFrame:
    """``url, child_ord, child`` of ``<sitemap>`` blocks."""
    pattern = F.lit(r"(?is)<sitemap>.*?<loc>\s*([^<\s]+)\s*</loc>")
    found = F.regexp_extract_all("body", pattern, F.lit(1))
    rows = numbered(parsed_documents(documents), ["url"], found, "child_ord", "raw")
    return rows.select("url", "child_ord", decode_xml(F.col("raw")).alias("child"))


def sitemap_index_expand(roots: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries reachable from each root document: index files followed two levels, five children each.

    ``roots``: ``site_key, candidate_ord, candidate, root_path``. Children whose URL mentions the docs path come
    first. Order is depth first, as a reader would meet them, and 5,000 entries per candidate are kept.
    """
    parsed = parsed_documents(documents).select("url", "body")
    entries, children = sitemap_entries(parsed), sitemap_children(parsed)
    root_path = F.regexp_replace("root_path", "/+$", "")
    keys = ["site_key", "candidate_ord", "candidate", "root_path"]

    def descend(level: DataFrame, depth: int) -> DataFrame:
        mentions = F.when((root_path != "") & F.contains(F.col("child"), root_path), 0).otherwise(1)
        nested = level.join(children.withColumnRenamed("url", "document"), "document").withColumn("mentions", mentions)
        picked = first_n(nested, [*keys, "trail", "document"], ["mentions", "child_ord"], K.MAX_SITEMAP_CHILDREN, "pick")
        return picked.select(
            *keys, F.col("child").alias("document"),
            F.concat("trail", F.array(F.col("pick"))).alias("trail"),
        )

    start = roots.select(*keys, F.col("candidate").alias("document"), F.array().cast("array<int>").alias("trail"))
    first = descend(start, 1)
    second = descend(first, 2)
    visited = start.unionByName(first).unionByName(second)
    rows = visited.join(entries.withColumnRenamed("url", "document"), "document")
    # A document's own entries precede those of its children, so the trail sorts parents first.
    ranked = first_n(rows, ["site_key", "candidate_ord"], ["trail", "ord"], K.MAX_SITEMAP_ENTRIES, "entry_ord")
    return ranked.select(*keys, "entry_ord", "loc", "lastmod")


def sitemap_candidates(sites: DataFrame, robots_sitemaps: DataFrame) -> DataFrame:
    """Where a site's sitemap may be, in order: three declared in robots.txt, the scope's own, the origin's.

    ``robots_sitemaps``: ``origin, sitemap_ord, sitemap``.
    """
    base = sites.select(
        "site_key", "scope_root",
        F.regexp_extract("scope_root", r"^([a-z]+://[^/]+)", 1).alias("origin"),
        F.regexp_extract("scope_root", r"^[a-z]+://[^/]+(.*)$", 1).alias("root_path"),
    )
    declared = first_n(robots_sitemaps, ["origin"], ["sitemap_ord"], K.MAX_DECLARED_SITEMAPS, "candidate_ord")
    declared = base.join(declared, "origin").select(
        "site_key", "root_path", "candidate_ord", F.col("sitemap").alias("candidate")
    )
    usual = base.select(
        "site_key", "root_path",
        F.posexplode(
            F.array(F.concat("scope_root", F.lit("/sitemap.xml")), F.concat("origin", F.lit("/sitemap.xml")))
        ).alias("pos", "candidate"),
    ).select("site_key", "root_path", (F.col("pos") + 1 + K.MAX_DECLARED_SITEMAPS).alias("candidate_ord"), "candidate")
    return first_per(declared.unionByName(usual), ["site_key", "candidate"], ["candidate_ord"])


def choose_scope_sitemap(
    sites: DataFrame, robots_sitemaps: DataFrame, documents: DataFrame, scope: Scope | None = None
) -> tuple[DataFrame, DataFrame]:
    """The first candidate with entries in scope, else the first that parsed.

    Returns ``(chosen, in_scope)``: ``site_key, sitemap_url`` and ``site_key, entry_ord, loc, lastmod``.
    """
    candidates = sitemap_candidates(sites, robots_sitemaps)
    parsed = candidates.join(
        parsed_documents(documents).select(F.col("url").alias("candidate")).distinct(), "candidate", "left_semi"
    )
    entries = sitemap_index_expand(parsed, documents)
    located = U.with_url(entries.join(sites.select("site_key", "scope_root"), "site_key"), "loc", "u_")
    located = U.with_url(located, "scope_root", "r_")
    inside = located.filter(
        F.col("u_valid") & U.in_scope(F.col("u_host"), F.col("u_path"), F.col("r_host"), F.col("r_path"), pages_only=False)
    )
    # Read twice below: to find the first useful candidate and to return its entries.
    inside = kept(inside.select("site_key", "candidate_ord", "entry_ord", "loc", "lastmod"), scope)
    useful = inside.groupBy("site_key").agg(F.min("candidate_ord").alias("useful_ord"))
    found = parsed.groupBy("site_key").agg(
        F.min(F.struct("candidate_ord", "candidate")).alias("first_found")
    )
    chosen = (
        found.join(useful, "site_key", "left")
        .join(parsed.select("site_key", F.col("candidate_ord").alias("useful_ord"), "candidate"),
              ["site_key", "useful_ord"], "left")
        .select("site_key", F.coalesce("candidate", "first_found.candidate").alias("sitemap_url"), "useful_ord")
    )
    in_scope = inside.join(
        chosen.select("site_key", F.col("useful_ord").alias("candidate_ord")), ["site_key", "candidate_ord"], "left_semi"
    )
    return chosen.drop("useful_ord"), in_scope.select("site_key", "entry_ord", "loc", "lastmod")
