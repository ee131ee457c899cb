"""Deterministic samples: evenly spaced URLs, link targets, anchor references and the page sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docgauge import constants as K
from docgauge.functions import urls as U
from docgauge.operators.common import first_n, first_per, order_buckets


def even_index(position: Column, total: Column, count: int) -> Column:
    """Whether the row at a zero-based position is one of ``floor(i * total / count)``, in double arithmetic."""
    stride = total / F.lit(float(count))
    near = F.floor(position / stride)
    hit = F.exists(
        F.array(near - 1, near, near + 1),
        lambda i: (i >= 0) & (i < count) & (F.floor(i * stride) == position),
    )
    return (total <= count) | hit


def pick_evenly(df: DataFrame, keys: list[str], value: str, count: int, bounded: bool = False) -> DataFrame:
    """Every Nth distinct value of a group in sorted order, ``count`` in all.

    ``bounded`` says a limit upstream already holds groups to a few thousand rows (a sitemap's 5,000 entries), so
    ranking inside one window is safe. Otherwise groups are cut into buckets by splitters that hashes of their own values choose, and only
    buckets that hold a wanted rank are sorted (``_ranked_buckets``): no group is sorted in one task, and computing any part of it
    again gives the same rows.
    """
    distinct = df.select(*keys, value).distinct()
    if bounded:
        group = Window.partitionBy(*keys)
        ranked = distinct.withColumns(
            {
                "__pos": F.row_number().over(group.orderBy(value)) - 1,
                "__total": F.count("*").over(group),
            }
        )
    else:
        ranked = _ranked_buckets(distinct, keys, value, count)
    return ranked.filter(even_index(F.col("__pos"), F.col("__total"), count)).drop("__pos", "__total")


def _ranked_buckets(distinct: DataFrame, keys: list[str], value: str, count: int) -> DataFrame:
    """Adds ``__pos`` and ``__total`` to the rows of buckets that hold a rank of ``even_index``; the other rows are left out."""
    placed = order_buckets(distinct, keys, F.col(value))
    sizes = placed.groupBy(*keys, "__bucket", "__total").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__bucket")  # at most some thousand buckets a group
    sizes = sizes.withColumn("__before", F.sum("__n").over(order) - F.col("__n"))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("__total") / F.lit(float(count)))))
    held = F.exists(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))
    sizes = sizes.filter((F.col("__total") <= count) | held).select(*keys, "__bucket", "__before")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value)
    rows = placed.join(sizes, [*keys, "__bucket"])
    return rows.withColumn("__pos", F.col("__before") + F.row_number().over(inside) - 1).drop("__bucket", "__before")


def choose_link_targets(references: DataFrame, sites: DataFrame) -> DataFrame:
    """Up to 30 links on the site and 15 elsewhere: the first 8 hosts found, at most 3 links each.

    ``references`` from ``collect_references``; ``sites``: ``site_key, scope_root``.
    """
    links = first_per(references.drop("fragment"), ["site_key", "url"], ["page_ord", "ref_ord"])
    links = U.with_url(links.join(sites.select("site_key", "scope_root"), "site_key"), "url", "u_")
    origin = F.regexp_extract("scope_root", r"^([a-z]+://[^/]+)", 1)
    links = links.withColumn("internal", F.col("u_origin") == origin)
    order = ["page_ord", "ref_ord"]
    internal = first_n(links.filter("internal"), ["site_key"], order, K.MAX_INTERNAL_LINKS)

    external = links.filter(~F.col("internal")).withColumn(
        "u_netloc", F.concat_ws(":", "u_host", F.nullif("u_port", F.lit("")))
    )
    hosts = external.groupBy("site_key", "u_netloc").agg(F.min(F.struct(*order)).alias("seen"))
    hosts = first_n(hosts, ["site_key"], ["seen"], K.MAX_EXTERNAL_HOSTS).select("site_key", "u_netloc")
    per_host = first_n(external, ["site_key", "u_netloc"], order, K.MAX_LINKS_PER_HOST)
    external = first_n(
        per_host.join(hosts, ["site_key", "u_netloc"], "left_semi"), ["site_key"], order, K.MAX_EXTERNAL_LINKS
    )
    columns = ["site_key", "page_ord", "ref_ord", "url", "from_url", "internal"]
    return internal.select(columns).unionByName(external.select(columns))


def section_fragments(references: DataFrame, sites: DataFrame) -> DataFrame:
    """References to a section on the site itself; hash routes and text fragments are not sections."""
    origin = F.regexp_extract("scope_root", r"^([a-z]+://[^/]+)", 1)
    on_site = references.join(sites.select("site_key", "scope_root"), "site_key").filter(
        F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1) == origin
    )
    return on_site.filter(F.col("fragment").isNotNull() & ~F.col("fragment").rlike(K.NOT_A_SECTION)).drop("scope_root")


def anchor_sample(references: DataFrame, sites: DataFrame) -> DataFrame:
    """The first 15 section references of a site."""
    return first_n(section_fragments(references, sites), ["site_key"], ["page_ord", "ref_ord"], K.MAX_ANCHOR_REFS)


def page_sample(sampled: DataFrame, sitemap: DataFrame, count: int = K.SAMPLE_PAGES) -> DataFrame:
    """Pages tested per site: the sample found, or evenly picked sitemap entries when it has fewer than five pages
    and the sitemap holds at least five.

    ``sampled``: ``site_key, page_ord, url, total_pages``; ``sitemap``: in-scope ``site_key, loc`` (5,000 at most).
    """
    found = sampled.groupBy("site_key").agg(F.count("*").alias("found"), F.max("total_pages").alias("total_pages"))
    listed = sitemap.groupBy("site_key").agg(F.count("*").alias("listed"))
    choice = found.join(listed, "site_key", "full").select(
        "site_key", "listed",
        ((F.coalesce("found", F.lit(0)) < K.MIN_PAGES) & (F.coalesce("listed", F.lit(0)) >= K.MIN_PAGES)).alias(
            "from_sitemap"
        ),
    )
    kept = sampled.join(choice.filter(~F.col("from_sitemap")).select("site_key"), "site_key", "left_semi").select(
        "site_key", "page_ord", "url", F.col("total_pages").cast("bigint").alias("total_pages")
    )
    fallback = sitemap.join(choice.filter("from_sitemap").select("site_key", "listed"), "site_key")
    picked = pick_evenly(fallback.select("site_key", "loc"), ["site_key"], "loc", count, bounded=True)
    picked = picked.withColumn(
        "page_ord", (F.row_number().over(Window.partitionBy("site_key").orderBy("loc")) - 1).cast("int")
    )
    picked = picked.join(choice.select("site_key", "listed"), "site_key").select(
        "site_key", "page_ord", F.col("loc").alias("url"), F.col("listed").cast("bigint").alias("total_pages")
    )
    return kept.unionByName(picked)
