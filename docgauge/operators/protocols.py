"""Optional interfaces a site offers, reported outside the score: llms-full.txt, an MCP server, agent skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docgauge.functions import urls as U
from docgauge.functions.numbers import grouped_text, plural
from docgauge.operators.common import first_per
from docgauge.operators.identity import registrable
from docgauge.sources.llms import advertised_mcp_urls

_TITLES = {
    "llms-full-txt": "llms-full.txt is available",
    "mcp-server": "MCP server is discoverable",
    "agent-skills": "Agent skills are published",
}


def mcp_answer(host: Column, status: Column, content_type: Column, authenticate: Column, body: Column) -> Column:
    """``open`` when an endpoint speaks MCP to a plain request, ``sign-in`` when it wants credentials first, else null."""
    kind = F.coalesce(content_type, F.lit(""))
    asks = F.coalesce(authenticate.rlike("(?i)bearer"), F.lit(False))
    json_like = F.contains(kind, F.lit("json"))
    return (
        F.when(F.contains(kind, F.lit("text/event-stream")), F.when(status == 200, "open"))
        .when((status == 401) & (asks | (json_like & F.startswith(host, F.lit("mcp.")))), "sign-in")
        .when(~json_like, None)
        .when(status == 200, F.when(body.rlike('"(jsonrpc|capabilities|serverInfo|protocolVersion)"'), "open"))
        .when(status.isin(400, 405, 406) & F.contains(body, F.lit('"jsonrpc"')), "open")
    )


def server_card(body: Column) -> Column:
    """Whether a JSON body describes an MCP server."""
    doc = F.try_parse_json(body)
    keys = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))

    def has(name: str) -> Column:
        return F.array_contains(keys, name)

    named = has("name") & (has("remotes") | has("endpoints") | has("transport") | has("tools"))
    return F.coalesce(has("serverInfo") | named, F.lit(False))


def skill_count(body: Column) -> Column:
    """Skills listed by an index: a JSON array, or an object with a ``skills`` array."""
    doc = F.try_parse_json(body)
    listed = F.coalesce(
        F.try_variant_get(doc, "$", "array<variant>"), F.try_variant_get(doc, "$.skills", "array<variant>")
    )
    return F.coalesce(F.size(listed), F.lit(0))


def _places(sites: DataFrame, addresses: list[Column]) -> DataFrame:
    """Candidate URLs of a site in order, closing slashes off, repeats dropped."""
    urls = U.unique_urls(F.array(*addresses))
    return sites.select("site_key", F.posexplode(urls).alias("candidate_ord", "url"))


def _row(rows: DataFrame, check_id: str, found: Column, fix: str, missing: Column) -> DataFrame:
    return rows.select(
        "site_key",
        F.lit(check_id).alias("id"),
        F.lit(_TITLES[check_id]).alias("title"),
        F.when(F.col("hit_url").isNotNull(), "found").otherwise("missing").alias("status"),
        F.when(F.col("hit_url").isNotNull(), found).otherwise(missing).alias("message"),
        F.when(F.col("hit_url").isNull(), fix).alias("fix"),
        F.when(F.col("hit_url").isNotNull(), F.array("hit_url")).alias("evidence"),
    )


def _roots(sites: DataFrame) -> DataFrame:
    return sites.select("site_key", "scope_root", F.regexp_extract("scope_root", r"^([a-z]+://[^/]+)", 1).alias("origin"))


def llms_full_txt(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """``responses``: ``url, status, content_type, body, truncated, final_url, headers``."""
    roots = _roots(sites)
    places = _places(roots, [F.concat("scope_root", F.lit("/llms-full.txt")), F.concat("origin", F.lit("/llms-full.txt"))])
    usable = responses.filter(
        (F.col("status") == 200)
        & ~F.contains(F.coalesce("content_type", F.lit("")), F.lit("html"))
        & (F.length(F.trim("body")) >= 200)
    ).select("url", "final_url", F.length("body").alias("chars"), "truncated")
    hits = first_per(places.join(usable, "url"), ["site_key"], ["candidate_ord"])
    size = F.when(F.col("truncated"), "over 2 MB").otherwise(F.concat(grouped_text(F.col("chars")), F.lit(" characters")))
    rows = roots.join(hits.select("site_key", F.coalesce("final_url", "url").alias("hit_url"), size.alias("size")), "site_key", "left")
    found = F.concat(F.lit("llms-full.txt found at "), "hit_url", F.lit(" ("), "size", F.lit(")."))
    missing = F.concat(
        F.lit("No llms-full.txt found at "),
        F.array_join(
            U.unique_urls(F.array(F.concat("scope_root", F.lit("/llms-full.txt")), F.concat("origin", F.lit("/llms-full.txt")))),
            " or ",
        ),
        F.lit("."),
    )
    return _row(rows, "llms-full-txt", found, "Publish /llms-full.txt with the full text of your docs in Markdown.", missing)


def mcp_server(sites: DataFrame, llms_txt: DataFrame, responses: DataFrame, suffixes: DataFrame) -> DataFrame:
    """First hit of: endpoints named in llms.txt, usual paths, a server card, the domain's own ``mcp.`` host."""
    roots = registrable(
        U.with_url(_roots(sites), "scope_root", "r_"), "r_host", suffixes
    ).join(llms_txt.select("site_key", "content"), "site_key", "left")

    def stage(ordinal: int, urls: Column, kind: str) -> DataFrame:
        return roots.select(
            "site_key", F.lit(ordinal).alias("stage"), F.lit(kind).alias("kind"),
            F.posexplode(U.unique_urls(urls)).alias("candidate_ord", "url"),
        )

    def at(root: str, path: str) -> Column:
        return F.concat(F.col(root), F.lit(path))

    named = F.coalesce(advertised_mcp_urls(F.col("content")), F.array().cast("array<string>"))
    host = F.concat(F.lit("https://mcp."), F.col("base_domain"))
    places = (
        stage(0, F.concat(named, F.array(at("scope_root", "/mcp"), at("scope_root", "/_mcp"), at("origin", "/mcp"))), "endpoint")
        .unionByName(
            stage(
                1,
                F.array(at("scope_root", "/.well-known/mcp/server-card.json"), at("origin", "/.well-known/mcp/server-card.json")),
                "card",
            )
        )
        .unionByName(stage(2, F.array(host, F.concat(host, F.lit("/mcp"))), "endpoint"))
    )
    final = F.coalesce("final_url", "url")
    answers = responses.withColumn("final", final)
    answers = U.with_url(answers, "final", "f_").select(
        "url", "final",
        mcp_answer(
            F.col("f_host"), F.col("status"), F.col("content_type"), F.element_at("headers", "www-authenticate"), F.col("body")
        ).alias("answer"),
        ((F.col("status") == 200) & server_card(F.col("body"))).alias("card"),
    ).filter(F.col("answer").isNotNull() | F.col("card"))
    hits = places.join(answers, "url").filter(
        F.when(F.col("kind") == "card", F.col("card")).otherwise(F.col("answer").isNotNull())
    )
    best = first_per(hits, ["site_key"], ["stage", "candidate_ord"]).select("site_key", F.col("final").alias("hit_url"), "kind", "answer")
    rows = sites.select("site_key").join(best, "site_key", "left")
    found = (
        F.when(F.col("kind") == "card", F.concat(F.lit("An MCP server is described at "), "hit_url", F.lit(".")))
        .when(
            F.col("answer") == "sign-in",
            F.concat(F.lit("An MCP server answers at "), "hit_url", F.lit("; agents need to sign in to use it.")),
        )
        .otherwise(F.concat(F.lit("An MCP server answers at "), "hit_url", F.lit(".")))
    )
    return _row(
        rows, "mcp-server", found, "Offer a read-only MCP server with a search tool over your docs, linked from llms.txt.",
        F.lit("No MCP server was found for these docs."),
    )


def agent_skills(sites: DataFrame, responses: DataFrame) -> DataFrame:
    roots = _roots(sites)
    paths = ("/.well-known/agent-skills/index.json", "/.well-known/skills/index.json")
    places = _places(roots, [F.concat(F.col(r), F.lit(p)) for r in ("scope_root", "origin") for p in paths])
    counted = responses.filter(F.col("status") == 200).select("url", "final_url", skill_count(F.col("body")).alias("skills"))
    hits = first_per(places.join(counted.filter(F.col("skills") > 0), "url"), ["site_key"], ["candidate_ord"])
    rows = roots.join(hits.select("site_key", F.coalesce("final_url", "url").alias("hit_url"), "skills"), "site_key", "left")
    found = F.concat(plural(F.col("skills"), "agent skill"), F.lit(" published at "), "hit_url", F.lit("."))
    return _row(
        rows, "agent-skills", found,
        "Publish an Agent Skills index at /.well-known/agent-skills/index.json with a SKILL.md for your main tasks.",
        F.lit("No agent skills index was found at /.well-known/agent-skills/index.json."),
    )


def additional_checks(
    sites: DataFrame, llms_txt: DataFrame, responses: DataFrame, suffixes: DataFrame
) -> DataFrame:
    return (
        mcp_server(sites, llms_txt, responses, suffixes)
        .unionByName(llms_full_txt(sites, responses))
        .unionByName(agent_skills(sites, responses))
    )
