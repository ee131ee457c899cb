"""Page facts and the tables exploded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docgauge import constants as K
from docgauge.functions import dates as D, html as H, urls as U
from docgauge.functions.let import bind
from docgauge.functions.text import sanitize
from docgauge.operators.common import first_n, first_per, numbered


def read_pages(responses: DataFrame) -> DataFrame:
    """Readable HTML pages, one row per requested URL, the first fetch kept."""
    usable = responses.filter(F.col("status").between(200, 299) & F.contains(F.col("content_type"), F.lit("html")))
    firsts = first_per(usable, ["site_key", "url"], ["fetch_ord"])
    return firsts.select(
        "site_key",
        F.col("fetch_ord").alias("page_ord"),
        "url",
        F.col("body").alias("html"),
        F.element_at("headers", "last-modified").alias("last_modified"),
    )


def page_facts(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """One pass over page HTML: text, title, links, anchors, metas and the declared date. The HTML itself is dropped.

    Staged projections keep each expensive string (cleaned page, content element, text) computed once.
    """
    now = F.current_timestamp() if now is None else now
    clean, content = F.col("clean"), F.col("content")
    staged = pages.withColumns({"json_ld": H.json_ld(F.col("html")), "clean": H.without_noise(F.col("html"))})
    staged = staged.withColumn("content", H.content_html(clean))
    staged = staged.withColumns({"text": H.text_of(content), "metas": H.meta_values(clean)})
    return staged.select(
        *[c for c in pages.columns if c not in ("html", "last_modified")],
        U.page_key(F.col("url")).alias("page_key"),
        H.title_of(clean).alias("title"),
        "text",
        "json_ld",
        H.anchor_ids(clean).alias("anchors"),
        H.hrefs(content).alias("hrefs"),
        H.meta_value(F.col("metas"), "property", "og:site_name").alias("og_site_name"),
        H.meta_value(F.col("metas"), "name", "generator").alias("generator"),
        declared_update_date(now).alias("declared_at"),
    )


def declared_update_date(now: Column) -> Column:
    """Most reliable source first: metas, JSON-LD, visible text, ``<time>``, the response header."""

    def first_valid(values: Column) -> Column:
        return F.get(F.filter(F.transform(values, lambda v: D.to_date(v)), lambda d: d.isNotNull()), F.lit(0))

    metas = F.array(*[H.meta_value(F.col("metas"), key, name) for key, name in K.UPDATE_METAS])
    modified = F.transform("json_ld", lambda b: F.regexp_extract(b, r'"dateModified"\s*:\s*"([^"]+)"', 1))
    visible = F.regexp_extract("text", K.UPDATED_TEXT, 2)
    return F.coalesce(
        first_valid(metas),
        first_valid(modified),
        bind(visible, lambda said: F.when(said != "", D.first_date_in(said, now))),
        first_valid(H.time_values(F.col("content"))),
        D.to_date(F.col("last_modified")),
    )


def all_references(facts: DataFrame) -> DataFrame:
    """Links in page content: absolute URL and decoded fragment, in the order found."""
    rows = numbered(facts, ["site_key", "page_ord", F.col("url").alias("from_url")], "hrefs", "ref_ord", "href")
    rows = rows.withColumn("ref", U.resolve_href(F.col("from_url"), F.col("href"))).filter(F.col("ref").isNotNull())
    return rows.select("site_key", "page_ord", "from_url", "ref_ord", "ref.url", "ref.fragment")


def content_references(facts: DataFrame) -> DataFrame:
    """``all_references``, distinct per page."""
    return first_per(all_references(facts), ["site_key", "from_url", "url", "fragment"], ["ref_ord"])


def collect_references(references: DataFrame) -> DataFrame:
    """Distinct references per site, the first page kept as their source; asset links are left out."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    linked = references.filter(~path.rlike(K.SKIPPED_EXTENSIONS))
    return first_per(linked, ["site_key", "url", "fragment"], ["page_ord", "ref_ord"])


def content_links(references: DataFrame) -> DataFrame:
    """References, distinct or not, without fragments, distinct per page."""
    return first_per(references.drop("fragment"), ["site_key", "from_url", "url"], ["ref_ord"])


def normalize_api_path(path: Column) -> Column:
    trimmed = F.regexp_replace(path, r"[.,;:)]+$", "")
    generic = F.regexp_replace(trimmed, r"\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*", "{}")
    bare = F.regexp_replace(generic, "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def endpoint_mentions(facts: DataFrame) -> DataFrame:
    """``METHOD /path`` in page text, with the words either side."""
    pattern = F.lit(K.ENDPOINT_MENTION)
    found = facts.select(
        "site_key", "page_ord", "url", "text",
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("found"),
    )
    # Offsets: text before a mention is the pieces and mentions that precede it.
    lengths = F.transform(F.split("text", K.ENDPOINT_MENTION, -1), F.length)
    sizes = F.transform("found", F.length)
    spans = F.aggregate(
        F.arrays_zip(F.slice(lengths, F.lit(1), F.size("found")).alias("gap"), sizes.alias("size")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    def with_context(zipped: Column) -> Column:
        start = zipped["starts"]
        begin = F.greatest(start - K.CONTEXT_CHARS, F.lit(0))
        context = F.substr("text", begin + 1, start - begin + F.length(zipped["found"]) + K.CONTEXT_CHARS)
        return F.struct(zipped["found"].alias("mention"), context.alias("context"))

    # The words around are cut inside the array, so that the page's text is not copied once for every mention.
    told = found.withColumn("starts", spans).select("site_key", "page_ord", "url", F.transform(F.arrays_zip("found", "starts"), with_context).alias("told"))
    rows = numbered(told, ["site_key", "page_ord", "url"], "told", "mention_ord", "m").select("*", "m.*")
    method = F.regexp_extract("mention", r"^([A-Z]+)", 1)
    path = F.regexp_extract("mention", r"(/\S+)$", 1)
    return rows.select(
        "site_key", "page_ord", F.col("url").alias("page"), "mention_ord",
        F.concat_ws(" ", method, normalize_api_path(path)).alias("operation"),
        "context",
    )


def site_name(facts: DataFrame, sites: DataFrame) -> DataFrame:
    """Display name per site: the commonest og:site_name (entry page counts twice), else the title part all pages
    share, else the registrable name. ``sites``: ``site_key, name_core``."""
    entry = facts.groupBy("site_key").agg(
        F.min_by("title", "page_ord").alias("title"),
        F.min("page_ord").alias("entry_ord"),
    )
    voted = facts.join(entry.select("site_key", "entry_ord"), "site_key")
    votes = (
        voted.filter(F.trim("og_site_name") != "")
        .groupBy("site_key", F.trim("og_site_name").alias("candidate"))
        .agg(
            F.sum(F.when(F.col("page_ord") == F.col("entry_ord"), 2).otherwise(1)).alias("votes"),
            F.min("page_ord").alias("seen"),
        )
    )
    og_name = votes.groupBy("site_key").agg(
        F.max_by("candidate", F.struct("votes", (-F.col("seen")).alias("s"))).alias("og_name")
    )
    shared = shared_title_part(facts)
    joined = sites.join(entry, "site_key", "left").join(og_name, "site_key", "left").join(shared, "site_key", "left")
    cleaned = sanitize(F.regexp_replace(F.coalesce("og_name", "shared_part"), K.GENERIC_SUFFIX, ""))
    core = F.col("name_core")
    from_domain = F.concat(F.upper(F.left(core, F.lit(1))), F.substr(core, F.lit(2)))
    return joined.select(
        "site_key",
        F.when(F.length(cleaned).between(2, 40), cleaned).otherwise(from_domain).alias("name"),
        F.left(sanitize(F.col("title")), F.lit(120)).alias("title"),
    )


def shared_title_part(facts: DataFrame) -> DataFrame:
    """The last title part (in the first page's order) that every titled page carries; needs two titled pages.

    Counted per (site, part) instead of collecting titles, so a large site stays spread out.
    """
    titled = facts.filter(F.col("title").isNotNull()).select("site_key", "page_ord", "title")
    split = F.array_distinct(F.transform(F.split("title", r"\s+[|·•–—-]\s+"), lambda part: F.trim(part)))
    parts = numbered(titled, ["site_key", "page_ord"], split, "part_ord", "part")
    totals = titled.groupBy("site_key").agg(F.count("*").alias("pages"), F.min("page_ord").alias("first_ord"))
    counted = parts.groupBy("site_key", "part").agg(
        F.count("*").alias("holding"), F.min(F.struct("page_ord", "part_ord")).alias("first")
    )
    common = counted.join(totals, "site_key").filter(
        (F.col("pages") >= 2) & (F.col("holding") == F.col("pages")) & (F.col("first.page_ord") == F.col("first_ord"))
    )
    return common.groupBy("site_key").agg(F.max_by("part", F.col("first.part_ord")).alias("shared_part"))


def source_pages(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Pages questions are written from: raw text of 400 characters or more, else a rendered copy that has it.

    ``pages`` may carry ``rendered`` text; only the first ten URLs per site count, and two renders.
    """
    rendered = F.col("rendered") if "rendered" in pages.columns else F.lit(None).cast("string")
    # Sizes and prompts are cut before rows are moved, so that whole texts move only where a reader takes ``text``.
    cut = lambda text, kind: [F.length(text).alias(f"{kind}size"), F.left(text, F.lit(K.MAX_CHARS_PER_SOURCE_PAGE)).alias(f"{kind}prompt")]
    # an unreadable page uses up a place, so the first are chosen before facts are looked at
    places = pages.select("site_key", "page_ord", "url", rendered.alias("rendered"), *cut(rendered, "rendered_"))
    places = first_n(places, ["site_key"], ["page_ord"], K.MAX_SOURCE_PAGES)
    first = places.join(facts.select("site_key", "page_ord", "title", "text", *cut(F.col("text"), "")), ["site_key", "page_ord"])
    thin = F.col("size") < K.MIN_SOURCE_TEXT
    columns = ["site_key", "page_ord", "url", F.coalesce("title", "url").alias("title")]
    readable = first.filter(~thin).select(*columns, "text", F.col("prompt").alias("prompt_text"), F.lit(False).alias("needs_javascript"))
    rendered = first_n(first.filter(thin), ["site_key"], ["page_ord"], K.MAX_RENDERED_PAGES)
    rendered = rendered.filter(F.col("rendered_size") >= K.MIN_SOURCE_TEXT).select(
        *columns, F.col("rendered").alias("text"), F.col("rendered_prompt").alias("prompt_text"), F.lit(True).alias("needs_javascript"),
    )
    return readable.unionByName(rendered)


def page_set(pages: DataFrame, sample: DataFrame) -> DataFrame:
    """The sampled pages of a site if any could be read, else all its pages. ``sample``: ``site_key, url``."""
    marked = pages.join(
        sample.select("site_key", "url").distinct().withColumn("sampled", F.lit(True)), ["site_key", "url"], "left"
    )
    any_sampled = (
        marked.groupBy("site_key").agg(F.coalesce(F.bool_or("sampled"), F.lit(False)).alias("any_sampled"))
    )
    kept = marked.join(any_sampled, "site_key").filter(F.col("sampled") | ~F.col("any_sampled"))
    return kept.drop("sampled", "any_sampled")
