"""The 23 agent-docs checks: computed over crawl tables or taken in as results, then presented, summed and capped.

Points and most thresholds of these checks are not published with the scoring method, so ``DEFAULT_CONFIG`` holds our
own; results computed here carry ``definition_basis = 'native'``. Results of another runner can be loaded instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docgauge import constants as K
from docgauge.functions import html as H, urls as U
from docgauge.functions.numbers import round1
from docgauge.functions.text import clean_resolution, collapse, normalize_for_match
from docgauge.operators.common import first_n

# Our defaults: points per check on the 10/7/4/2 scale, and thresholds.
DEFAULT_POINTS = {
    "llms-txt-exists": 10, "llms-txt-valid": 4, "llms-txt-size": 7, "llms-txt-links-resolve": 7,
    "llms-txt-links-markdown": 7, "llms-txt-directive-html": 4, "llms-txt-directive-md": 4, "markdown-url-support": 7,
    "content-negotiation": 4, "rendering-strategy": 10, "page-size-markdown": 7, "page-size-html": 7,
    "content-start-position": 4, "tabbed-content-serialization": 4, "section-header-quality": 2,
    "markdown-code-fence-validity": 4, "http-status-codes": 7, "redirect-behavior": 4, "llms-txt-coverage": 4,
    "markdown-content-parity": 4, "cache-header-hygiene": 2, "auth-gate-detection": 10, "auth-alternative-access": 7,
}
DEFAULT_CONFIG = {
    "llms_txt_bytes": 50_000,
    "page_chars": K.MAX_CHARS_PER_FETCH,
    "rendered_text_chars": K.MIN_SOURCE_TEXT,
    "content_start_share": 0.5,
    "directive_chars": 5_000,
    "directive_lines": 10,
    "tab_chars": 40_000,
    "parity_share": 0.85,
    "max_age_seconds": 86_400,
    "pass_share": 0.9,
    "warn_share": 0.5,
}
# Our default edges, in the order the checks run: each inner tuple is an OR-group, groups are ANDed.
DEFAULT_DEPENDENCIES = (
    ("llms-txt-valid", (("llms-txt-exists",),)),
    ("llms-txt-size", (("llms-txt-exists",),)),
    ("llms-txt-links-resolve", (("llms-txt-exists",),)),
    ("llms-txt-links-markdown", (("llms-txt-exists",),)),
    ("llms-txt-coverage", (("llms-txt-exists",),)),
    ("llms-txt-directive-md", (("markdown-url-support", "content-negotiation"),)),
    ("page-size-markdown", (("markdown-url-support", "content-negotiation"),)),
    ("markdown-code-fence-validity", (("markdown-url-support", "content-negotiation"),)),
    ("markdown-content-parity", (("markdown-url-support", "content-negotiation"),)),
)
_PAGE_CHECKS = (
    "llms-txt-directive-html", "llms-txt-directive-md", "markdown-url-support", "content-negotiation",
    "rendering-strategy", "page-size-markdown", "page-size-html", "content-start-position",
    "tabbed-content-serialization", "section-header-quality", "markdown-code-fence-validity", "http-status-codes",
    "redirect-behavior", "markdown-content-parity", "cache-header-hygiene", "auth-gate-detection",
)


def check_table(points: dict[str, float] | None = None) -> Column:
    """Map of check id to points as a literal."""
    points = points or DEFAULT_POINTS
    return F.create_map(*[x for k, v in points.items() for x in (F.lit(k), F.lit(float(v)))])


def page_probes(pages: DataFrame, config: dict | None = None) -> DataFrame:
    """Per sampled page, a nullable verdict per page-level check (null: does not apply).

    ``pages``: ``site_key, url, status, content_type, final_url, html, cache_control`` of the plain request, ``md_status,
    md_type, md_body`` of the Markdown address, ``negotiated_type`` of the request asking for Markdown and
    ``probe_status`` of a made-up address next to the page.
    """
    c = {**DEFAULT_CONFIG, **(config or {})}
    staged = pages.withColumn("clean", H.without_noise(F.col("html")))
    staged = staged.withColumn("content", H.content_html(F.col("clean")))
    staged = staged.withColumn("text", H.text_of(F.col("content")))
    readable = F.col("status").between(200, 299)
    has_md = (F.col("md_status") == 200) & F.col("md_type").rlike("(?i)text/(markdown|plain)")
    head = F.concat_ws("\n", F.slice(F.split("md_body", "\n"), 1, c["directive_lines"]))
    start = F.instr("clean", F.col("content")) / F.length("clean")
    tabs = F.regexp_extract_all(
        "clean", F.lit(r"""(?is)<[a-z]+\b[^>]*role\s*=\s*["']?tabpanel["']?[^>]*>(.*?)</"""), F.lit(1)
    )
    tab_size = F.aggregate(tabs, F.lit(0), lambda n, t: n + F.length(t))
    headings = F.transform(
        F.filter(F.regexp_extract_all("content", F.lit(r"(?is)<h[2-6]\b[^>]*>(.*?)</h[2-6]\s*>"), F.lit(1)), lambda h: h != ""),
        lambda h: collapse(h),
    )
    fences = F.size(F.regexp_extract_all("md_body", F.lit(r"(?m)^\s{0,3}(`{3,}|~{3,})"), F.lit(0)))
    words = F.array_distinct(F.split(normalize_for_match(F.col("text")), " "))
    md_words = F.array_distinct(F.split(normalize_for_match(F.col("md_body")), " "))
    parity = F.size(F.array_intersect(words, md_words)) / F.size(words)
    max_age = F.regexp_extract("cache_control", r"(?i)max-age\s*=\s*(\d+)", 1).try_cast("bigint")
    host, landed = U.host_of(U.url_parts(F.col("url"))), U.host_of(U.url_parts(F.coalesce("final_url", "url")))

    verdicts = {
        "llms-txt-directive-html": F.when(readable, F.contains(F.lower(F.left("html", F.lit(c["directive_chars"]))), F.lit("llms.txt"))),
        "llms-txt-directive-md": F.when(has_md, F.contains(F.lower(head), F.lit("llms.txt"))),
        "markdown-url-support": F.when(readable, F.coalesce(has_md, F.lit(False))),
        "content-negotiation": F.when(readable, F.coalesce(F.col("negotiated_type").rlike("(?i)text/markdown"), F.lit(False))),
        "rendering-strategy": F.when(readable, F.length("text") >= c["rendered_text_chars"]),
        "page-size-markdown": F.when(has_md, F.length("md_body") <= c["page_chars"]),
        "page-size-html": F.when(readable, F.length("clean") <= c["page_chars"]),
        "content-start-position": F.when(readable, start <= c["content_start_share"]),
        "tabbed-content-serialization": F.when(readable & (F.size(tabs) > 0), tab_size <= c["tab_chars"]),
        "section-header-quality": F.when(readable & (F.size(tabs) > 0), F.size(F.array_distinct(headings)) == F.size(headings)),
        "markdown-code-fence-validity": F.when(has_md, fences % 2 == 0),
        "http-status-codes": F.when(F.col("probe_status").isNotNull(), F.col("probe_status").isin(404, 410)),
        "redirect-behavior": F.when(F.col("status").isNotNull(), U.bare_host(host) == U.bare_host(landed)),
        "markdown-content-parity": F.when(has_md & readable, parity >= c["parity_share"]),
        "cache-header-hygiene": F.when(readable, F.coalesce(max_age <= c["max_age_seconds"], F.lit(True))),
        "auth-gate-detection": F.when(F.col("status").isNotNull(), ~F.col("status").isin(401, 403)),
    }
    probes = F.array(*[F.struct(F.lit(k).alias("id"), verdicts[k].alias("ok")) for k in _PAGE_CHECKS])
    return staged.select("site_key", "url", F.explode(probes).alias("p")).select("site_key", "url", "p.id", "p.ok")


def llms_txt_probes(sites: DataFrame, llms_txt: DataFrame, links: DataFrame, discovered: DataFrame, config: dict | None = None) -> DataFrame:
    """``site_key, id, proportion`` of the llms.txt checks; null where there is no file to judge.

    ``llms_txt``: ``site_key, status, content_type, content``; ``links``: ``site_key, link, status, content_type``;
    ``discovered``: ``site_key, page_key`` of the site's pages.
    """
    c = {**DEFAULT_CONFIG, **(config or {})}
    is_text = (F.col("status") == 200) & F.coalesce(F.col("content_type").rlike("(?i)^text/(plain|markdown)"), F.lit(False))
    file = llms_txt.groupBy("site_key").agg(F.max_by("content", is_text).alias("content"), F.max(is_text).alias("there"))
    resolved = links.groupBy("site_key").agg(
        F.avg(F.coalesce(F.col("status") == 200, F.lit(False)).cast("double")).alias("resolve"),
        F.avg(
            (F.col("link").rlike(r"(?i)\.mdx?([?#]|$)") | F.coalesce(F.col("content_type").rlike("(?i)text/markdown"), F.lit(False))).cast("double")
        ).alias("markdown"),
    )
    listed = links.select("site_key", U.page_key(F.col("link")).alias("page_key")).distinct().withColumn("listed", F.lit(1.0))
    covered = discovered.select("site_key", "page_key").distinct().join(listed, ["site_key", "page_key"], "left")
    covered = covered.groupBy("site_key").agg(F.avg(F.coalesce("listed", F.lit(0.0))).alias("covered"))
    rows = (
        sites.select("site_key").join(file, "site_key", "left").join(resolved, "site_key", "left").join(covered, "site_key", "left")
    )
    there = F.coalesce("there", F.lit(False))
    valid = F.col("content").rlike(r"(?s)\A\s*# [^\n]+\n\s*> [^\n]+\n.*?^?## [^\n]+")
    values = {
        "llms-txt-exists": there.cast("double"),
        "llms-txt-valid": F.when(there, valid.cast("double")),
        "llms-txt-size": F.when(there, (F.octet_length("content") < c["llms_txt_bytes"]).cast("double")),
        "llms-txt-links-resolve": F.when(there, F.col("resolve")),
        "llms-txt-links-markdown": F.when(there, F.col("markdown")),
        "llms-txt-coverage": F.when(there, F.col("covered")),
    }
    stacked = F.array(*[F.struct(F.lit(k).alias("id"), v.alias("proportion")) for k, v in values.items()])
    return rows.select("site_key", F.explode(stacked).alias("p")).select("site_key", "p.id", "p.proportion")


def native_results(
    sites: DataFrame, probes: DataFrame, llms: DataFrame, alternatives: DataFrame,
    points: dict[str, float] | None = None, config: dict | None = None,
) -> DataFrame:
    """The 23 results per site. ``alternatives``: ``site_key`` of sites with llms-full.txt, Markdown or an MCP server."""
    c = {**DEFAULT_CONFIG, **(config or {})}
    measured = probes.groupBy("site_key", "id").agg(F.avg(F.col("ok").cast("double")).alias("proportion"))
    # Three failing pages per check are evidence enough; the cut happens before they are gathered.
    bad = first_n(probes.filter(~F.col("ok")), ["site_key", "id"], ["url"], 3)
    bad = bad.groupBy("site_key", "id").agg(
        F.array_sort(F.collect_list(F.struct("url", F.lit("fail").alias("status")))).alias("page_results")
    )
    gated = measured.filter((F.col("id") == "auth-gate-detection") & (F.col("proportion") < 1)).select("site_key")
    other = alternatives.select("site_key").distinct().withColumn("alt", F.lit(1.0))
    alternative = gated.join(other, "site_key", "left").select(
        "site_key", F.lit("auth-alternative-access").alias("id"), F.coalesce("alt", F.lit(0.0)).alias("proportion")
    )
    ids = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(cat).alias("category")) for i, _, cat in K.AGENT_DOCS_CHECKS])
    grid = sites.select("site_key", F.explode(ids).alias("c")).select("site_key", "c.id", "c.category")
    rows = grid.join(
        measured.unionByName(llms).unionByName(alternative), ["site_key", "id"], "left"
    ).join(bad, ["site_key", "id"], "left")
    share = F.col("proportion")
    status = F.when(share.isNull(), "skip").when(share >= c["pass_share"], "pass").when(share >= c["warn_share"], "warn").otherwise("fail")
    top = F.element_at(check_table(points), F.col("id"))
    message = F.when(share.isNull(), "Nothing to measure on this site.").otherwise(
        F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("% of what was measured passes."))
    )
    return rows.select(
        "site_key", "id", "category", status.alias("status"), message.alias("message"),
        F.lit(None).cast("string").alias("resolution"), share.alias("proportion"),
        F.when(share.isNotNull(), "numeric").alias("display_mode"),
        F.when(share.isNotNull(), top * share).alias("earned"), top.alias("max"), "page_results",
    )


def _rule_levels(rules) -> list[int]:
    """The round in which each rule applies: rules of a round see what earlier rounds skipped, as if taken one by one in order."""
    levels: list[int] = []
    for check, groups in rules:
        needs = {d for group in groups for d in group}
        level = 0
        for (other, other_groups), at in zip(rules, levels):
            if other in needs:
                level = max(level, at + 1)
            elif check in {d for group in other_groups for d in group}:
                level = max(level, at)
        levels.append(level)
    return levels


def check_dependencies(results: DataFrame, dependencies=DEFAULT_DEPENDENCIES, order: list[str] | None = None) -> DataFrame:
    """Marks a check skipped when dependencies ran and some OR-group of them neither passed nor warned.

    Rules apply in the given order, later ones seeing earlier skips. Where a site has a check more than once, its last row by ``order``
    counts as a dependency (ties: the greater status); without an order, one row that passes or warns is enough. A skip marks all rows of
    the check. Rows without a site or id stay as they are.

    A site is two short bit masks, the checks it ran and those that passed: rows are first reduced to one per (site, check) among the checks
    that rules name, rules are tested on the masks in rounds, and only skipped (site, check) pairs are joined back.
    """
    rules = [(check, tuple(tuple(group) for group in groups)) for check, groups in dependencies]
    named = sorted({i for check, groups in rules for i in (check, *(d for group in groups for d in group))})
    if not rules:
        return results
    words = -(-len(named) // 62)
    place = {name: divmod(at, 62) for at, name in enumerate(named)}

    def mask(word: int, ids) -> Column:
        return F.lit(sum({1 << place[i][1] for i in ids if place[i][0] == word})).cast("bigint")

    def touches(kind: str, ids) -> Column:
        tests = [F.col(f"__{kind}{w}").bitwiseAND(mask(w, ids)) != 0 for w in range(words) if any(place[i][0] == w for i in ids)]
        return reduce(lambda x, y: x | y, tests, F.lit(False))

    good = F.col("status").isin("pass", "warn")
    if order:
        # The status joins the order, so that equal places still give one answer.
        last = F.max_by("status", F.struct(*order, "status"))
        ok = F.coalesce(last.isin("pass", "warn"), F.lit(False))
    else:
        ok = F.coalesce(F.bool_or(good), F.lit(False))
    each = results.filter(F.col("id").isin(*named) & F.col("site_key").isNotNull()).groupBy("site_key", "id").agg(ok.alias("__ok"))
    bits = F.create_map(*[x for name in named for x in (F.lit(name), F.struct(F.lit(place[name][0]).alias("w"), mask(place[name][0], [name]).alias("b")))])
    at = F.element_at(bits, F.col("id"))
    masks = []
    for w in range(words):
        mine = F.when(at["w"] == w, at["b"])
        masks += [
            F.coalesce(F.bit_or(mine), F.lit(0).cast("bigint")).alias(f"__ran{w}"),
            F.coalesce(F.bit_or(F.when(F.col("__ok"), mine)), F.lit(0).cast("bigint")).alias(f"__ok{w}"),
        ]
    sites = each.groupBy("site_key").agg(*masks).withColumns({f"__out{w}": F.lit(0).cast("bigint") for w in range(words)})
    levels = _rule_levels(rules)
    for level in range(max(levels) + 1):
        failing = []
        for (check, groups), mine in zip(rules, levels):
            if mine == level:
                met = reduce(lambda x, y: x & y, [touches("ok", group) for group in groups], F.lit(True))
                failing.append((check, touches("ran", [d for group in groups for d in group]) & ~met))
        out = {
            w: reduce(
                lambda x, y: x.bitwiseOR(y),
                [F.when(fails, mask(w, [check])).otherwise(mask(w, [])) for check, fails in failing if place[check][0] == w],
                mask(w, []),
            )
            for w in range(words)
        }
        sites = sites.select("*", *[out[w].alias(f"__new{w}") for w in range(words)])
        sites = sites.withColumns(
            {f"__ok{w}": F.col(f"__ok{w}").bitwiseAND(F.bitwise_not(f"__new{w}")) for w in range(words)}
            | {f"__out{w}": F.col(f"__out{w}").bitwiseOR(F.col(f"__new{w}")) for w in range(words)}
        ).drop(*[f"__new{w}" for w in range(words)])
    targets = F.array(*[F.when(touches("out", [check]), F.lit(check)) for check in sorted({check for check, _ in rules})])
    skips = sites.select("site_key", F.explode(F.array_compact(targets)).alias("id"), F.lit(True).alias("__skip"))
    joined = results.join(skips, ["site_key", "id"], "left")
    skipped = F.col("__skip").isNotNull() & ~F.coalesce(F.col("status") == "skip", F.lit(False))
    return joined.withColumns(
        {
            "message": F.when(skipped, "Skipped: dependency check did not pass").otherwise(F.col("message")),
            "earned": F.when(skipped, None).otherwise(F.col("earned")),
            "status": F.when(F.col("__skip").isNotNull(), "skip").otherwise(F.col("status")),
        }
    ).drop("__skip")


def cutoff_reclass(results: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """A failure our own limit or robots obedience caused is unfinished, not failed.

    ``cutoffs``: ``site_key, id, cut_off`` and, where a check was cut off more than once, ``cut_ord``: a limit outweighs the
    robots causes, of which the first stays.
    """
    why = {
        "limit": "the scan reached its time or request limit before this check could read everything it needed",
        "robots": "robots.txt asked our scanner not to read some pages this check needed, and we follow it",
        "robots_unreachable": "a robots.txt this check depended on could not be read, so our scanner did not fetch those pages",
    }
    ordinal = F.col("cut_ord") if "cut_ord" in cutoffs.columns else F.lit(0)
    rank = F.struct((F.col("cut_off") != "limit").alias("other"), ordinal.alias("ord"), "cut_off")
    one = cutoffs.groupBy("site_key", "id").agg(F.min_by("cut_off", rank).alias("cut_off"))
    joined = results.join(one, ["site_key", "id"], "left")
    hit = F.col("cut_off").isNotNull() & F.col("status").isin("fail", "warn")
    text = F.element_at(F.create_map(*[x for k, v in why.items() for x in (F.lit(k), F.lit(v))]), F.col("cut_off"))
    message = F.concat(
        F.lit("Not finished: "), text, F.lit(", so it is left out of the score. ("), F.col("message"), F.lit(")")
    )
    return joined.withColumns(
        {
            "message": F.when(hit, message).otherwise(F.col("message")),
            "status": F.when(hit, "error").otherwise(F.col("status")),
        }
    ).drop("cut_off")


def result_status_counts(results: DataFrame) -> DataFrame:
    names = ("pass", "warn", "fail", "skip", "error")
    return results.groupBy("site_key").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == n).alias(f"n_{n}") for n in names]
    )


def afdocs_checks(results: DataFrame) -> DataFrame:
    """Results as ``check_results`` rows: thin samples and errors are unverified, three problem pages are evidence."""
    ids = [i for i, _, _ in K.AGENT_DOCS_CHECKS]
    titles = F.create_map(*[x for i, t, _ in K.AGENT_DOCS_CHECKS for x in (F.lit(i), F.lit(t))])
    thin = F.coalesce(F.col("display_mode") == "notApplicable", F.lit(False))
    status = F.when(thin | ~F.col("status").isin("pass", "warn", "fail", "skip"), "unverified").otherwise(F.col("status"))
    counts = F.col("earned").isNotNull() & ~thin & ~status.isin("skip", "unverified")
    problems = F.slice(
        F.filter(
            F.coalesce("page_results", F.array().cast("array<struct<url:string,status:string>>")),
            lambda p: p["url"].isNotNull() & p["status"].isNotNull() & (p["status"] != "pass"),
        ),
        1, 3,
    )
    evidence = F.when((F.col("status") != "pass") & (F.size(problems) > 0), F.transform(problems, lambda p: p["url"]))
    return results.select(
        "site_key",
        F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id")).cast("int").alias("check_ord"),
        "id", F.lit("access").alias("group"), "category",
        F.coalesce(F.try_element_at(titles, F.col("id")), F.col("id")).alias("title"),
        status.alias("status"), F.lit("agent-docs").alias("source"),
        round1(F.col("max")).alias("max"), F.when(counts, round1(F.col("earned"))).alias("earned"),
        F.when(thin, F.concat(F.lit("Too few pages were read to score this. "), "message")).otherwise(F.col("message")).alias("message"),
        F.when(F.col("status") != "pass", clean_resolution(F.col("resolution"))).alias("fix"),
        evidence.alias("evidence"),
    )


def afdocs_cap(results: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The lowest cap the rules put on a site: ``site_key, cap_value, cap_check, cap_reason``; ties go by rule order."""
    share, judged = F.col("proportion"), F.coalesce(F.col("display_mode") != "notApplicable", F.lit(True))

    def cap(value: int, ordinal: int, check: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(value).alias("cap_value"), F.lit(ordinal).alias("ord"), check.alias("cap_check"), reason.alias("cap_reason")
        )

    from_results = F.when(
        (F.col("id") == "llms-txt-exists") & (F.col("status") == "fail"),
        cap(59, 0, F.col("id"), F.lit("No llms.txt found. Agents lose primary navigation.")),
    )
    for ordinal, check in ((1, "rendering-strategy"), (2, "auth-gate-detection")):
        here = (F.col("id") == check) & judged
        from_results = from_results.when(
            here & (share <= 0.25), cap(39, ordinal, F.col("id"), F.lit(f"{check}: 75%+ of pages affected"))
        ).when(here & (share <= 0.5), cap(59, ordinal, F.col("id"), F.lit(f"{check}: 50%+ of pages affected")))
    from_diagnostics = F.when(
        F.col("id") == "no-viable-path",
        cap(39, 3, F.col("id"), F.lit("Agents have no effective way to access documentation content.")),
    ).when(
        F.col("id") == "single-page-sample",
        cap(59, 4, F.col("id"), F.lit("Too few pages discovered to produce a representative score.")),
    )
    caps = results.select("site_key", from_results.alias("cap")).unionByName(
        diagnostics.select("site_key", from_diagnostics.alias("cap"))
    )
    lowest = caps.filter(F.col("cap").isNotNull()).groupBy("site_key").agg(F.min("cap").alias("cap"))
    return lowest.select("site_key", "cap.cap_value", "cap.cap_check", "cap.cap_reason")


def _summed(points: Column) -> Column:
    """Sum of points to one decimal; as decimals, so that it does not depend on the order of rows."""
    return round1(F.sum(points.cast("decimal(20,8)")).cast("double"))


def afdocs_summary(results: DataFrame, caps: DataFrame) -> DataFrame:
    """Earned, possible and passed per site with its cap; sites where no check is numeric have no row."""
    numeric = F.col("display_mode") == "numeric"
    rows = results.groupBy("site_key").agg(
        F.count_if(numeric).alias("numeric"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count("*").alias("total"),
        _summed(F.when(numeric, F.coalesce("earned", F.lit(0.0)))).alias("earned"),
        _summed(F.when(numeric, F.col("max"))).alias("possible"),
    )
    return rows.filter(F.col("numeric") > 0).drop("numeric").join(caps, "site_key", "left")
