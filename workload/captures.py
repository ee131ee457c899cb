"""Captured tables derived from the given ones by Spark, so that every query's work grows with its input.

``documents`` becomes a crawl: twenty neighbouring document numbers of one language are a site, so that the number of
sites follows the input, a source with a third of all rows is no hot site, and the limits that the method sets a site (pages,
children, entries) leave nothing out. Each document is one page with a title, metas, dates, endpoint mentions and links; sitemaps, robots files, API descriptions, a fetch log and answer
transcripts follow from the same rows. ``orders``/``lineitem`` become check results and ``events`` a fetch history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docgauge import constants as K
from docgauge.operators.identity import suffix_table

SPEC_JSON = (
    '{"openapi":"3.0.0","servers":[{"url":"https://api.example.com/v1"}],"paths":{'
    + ",".join(f'"/items/{i}":{{"get":{{"summary":"item"}},"parameters":[]}}' for i in range(30))
    + ',"/v1/orders/{id}/lines":{"post":{"deprecated":true},"get":{"deprecated":false}},"/broken":5}}'
)
SPEC_YAML = (
    "openapi: 3.0.0\nservers:\n  - url: /v1\npaths:\n"
    + "".join(f"  /items/{i}:\n    get:\n      summary: item\n" for i in range(20))
    + "  /orders/{id}/lines/:\n    post:\n      summary: old\n"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffixes(spark: SparkSession) -> DataFrame:
    """The few suffixes that the derived hosts have."""
    return suffix_table(spark, K.PUBLIC_SUFFIXES, K.PRIVATE_SUFFIXES)


def lit2(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``d, text, l, s, sn, site_key, scope_root, url, e, entry_url`` per document; ``e``: the page number in the sitemap, of a
    page without a document for every fifth."""
    bucket = F.expr("d div 20")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "text", F.col("lang").alias("l"))
    rows = rows.withColumns({"sn": (bucket % 20).cast("int"), "s": text("src", bucket % 20)})
    rows = rows.withColumn("site_key", text("docs.", F.col("s"), "-", F.col("l"), "-", bucket, ".example.com"))
    rows = rows.withColumn("scope_root", text("https://", F.col("site_key"), "/docs"))
    rows = rows.withColumn("e", F.col("d") + F.when(F.col("d") % 5 == 4, 1_000_000_000).otherwise(0))
    return rows.withColumns({"url": text(F.col("scope_root"), "/page-", F.col("d")), "entry_url": text(F.col("scope_root"), "/page-", F.col("e"))})


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("site_key", "scope_root", "s", "l", "sn").distinct()
    return rows.withColumns({"domain": F.col("site_key"), "profile": F.lit("developer-docs")})


def page_html() -> Column:
    d, l, s = F.col("d"), F.col("l"), F.col("s")

    def when(condition: Column, *parts) -> Column:
        return F.when(condition, text(*parts)).otherwise("")

    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return text(
        '<!DOCTYPE html><html lang="', l, '"><head><title>Page ', d, " | ", s, " Docs</title>",
        when(d % 3 == 0, '<meta property="article:modified_time" content="2024-', lit2(d % 12 + 1), "-", lit2(d % 28 + 1), '">'),
        when(d % 5 == 0, '<meta property="og:site_name" content="Site ', s, '">'),
        when(d % 7 == 0, '<meta name="generator" content="Docusaurus v3">'),
        when(
            d % 4 == 1, '<script type="application/ld+json">{"@type":"TechArticle","dateModified":"2023-',
            lit2(d % 12 + 1), '-05"}</script>',
        ),
        '<style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><a href="/docs">Home</a></nav>',
        '<main><article id="content-', d, '"><h1 id="top-', d % 5, '">Page ', d, "</h1> <p>", escaped, "</p> ",
        "<p>Call GET /v1/items/", d % 40, " or POST /v1/orders/{order_id}/lines", when(d % 6 == 0, " which is deprecated"), ".</p> ",
        when(d % 8 == 3, "<p>Last updated: March 3, 2024</p> "),
        when(d % 8 == 6, '<p><time datetime="2022-05-06">May</time></p> '),
        '<ul><li><a href="page-', d + 1, '">next</a></li> <li><a href="/docs/page-', d + 20, "#top-", (d + 20) % 5,
        '">far</a></li> <li><a href="#top-', (d + F.when(d % 10 == 0, 1).otherwise(0)) % 5,
        '">here</a></li> <li><a href="https://ext', d % 13, ".example.org/p/", d % 17,
        '">out</a></li> <li><a href="/img/', d, '.png">img</a></li> <li><a href="mailto:a@b.c">mail</a></li></ul>',
        "</article></main></body></html>",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived page with its HTML."""
    modified = F.when(F.col("d") % 9 == 4, "Wed, 21 Oct 2015 07:28:00 GMT")
    return docs(spark, sf_dir).select(
        "site_key", F.col("d").alias("page_ord"), "url", page_html().alias("html"), modified.alias("last_modified")
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HEAD and GET answers of every link on the derived pages and of every sitemap entry."""
    d = F.col("d")
    page = lambda k: text(F.col("scope_root"), "/page-", k)
    outside = text("https://ext", d % 13, ".example.org/p/", d % 17)

    def target(url: Column, k: Column, code: Column) -> Column:
        return F.struct(url.alias("url"), k.alias("k"), code.cast("int").alias("code"))

    ext_code = F.when((d % 13 + d % 17) % 4 == 0, 0).otherwise(9)
    rows = docs(spark, sf_dir).select(
        "site_key", "d",
        F.explode(
            F.array_distinct(F.array(
                target(page(d + 1), d + 1, (d + 1) % 10), target(page(d + 20), d + 20, (d + 20) % 10),
                target(outside, d % 17, ext_code), target(F.col("url"), d, d % 10),
                target(F.col("entry_url"), F.col("e"), d % 10),
            ))
        ).alias("t"),
    ).select("site_key", "d", "t.*")
    code = F.col("code")
    failure = F.when(code == 4, "dns").when(code == 5, "timeout")

    def answer(method: str, ordinal: int, status: Column, body: Column) -> Column:
        return F.struct(
            F.lit(method).alias("method"), (d * 10 + ordinal).alias("fetch_ord"), status.alias("status"), body.alias("body")
        )

    head = F.when(code == 0, 404).when(code == 1, 405).when(code == 2, 403).when(code == 3, 500).when(failure.isNull(), 200)
    get = F.when(code == 0, 404).when(code == 2, 403).when(code == 3, 500).when(failure.isNull(), 200)
    body = F.when((code == 1) | (code > 5), text('<html><body><h2 id="top-', F.col("k") % 5, '">x</h2></body></html>'))
    both = rows.select(
        "site_key", "url", failure.alias("failure"),
        F.explode(F.array(answer("HEAD", 0, head, F.lit(None).cast("string")), answer("GET", 1, get, body))).alias("a"),
    )
    return both.select("site_key", "url", "failure", "a.method", "a.fetch_ord", "a.status", "a.body")


def robots_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``origin, status, body`` per site."""
    sn, key = F.col("sn"), F.col("site_key")
    origin = text("https://", key)
    declared = (
        F.when(sn % 5 == 0, F.lit(""))
        .when(sn % 5 == 1, text("Sitemap: ", origin, "/missing.xml\nSitemap: ", origin, "/sitemap-index.xml\n"))
        .when(sn % 5 == 4, F.lit(""))
        .otherwise(text("Sitemap: ", origin, "/sitemap-index.xml\n"))
    )
    rules = (
        F.when(sn % 4 == 1, "User-agent: *\nDisallow: /private # hidden\nAllow: /private/public\n")
        .when(
            sn % 4 == 2,
            "User-agent: Googlebot\nUser-agent: GPTBot\nUser-agent: ChatGPT-User\nDisallow: /docs\n\nUser-agent: *\n"
            "Disallow: /docs*\nAllow: /docs/$\nCrawl-delay: 2\n",
        )
        .otherwise("User-agent: *\nDisallow:\nCrawl-delay: 0.5\n")
    )
    status = F.when((sn % 4 == 3) & (F.col("l") == "en"), 404).when((sn % 4 == 3) & (F.col("l") == "fr"), 500).otherwise(200)
    return sites(spark, sf_dir).select(origin.alias("origin"), status.alias("status"), F.concat(rules, declared).alias("body"))


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, body``: an index per site that names ten url sets, of which four exist (two thirds of the pages)."""
    rows = docs(spark, sf_dir).filter((F.col("d") % 3 != 0) & (F.col("sn") % 5 != 4))
    origin = text("https://", F.col("site_key"))
    lastmod = F.when(F.col("d") % 2 == 0, text("<lastmod>2024-01-", lit2(F.col("d") % 28 + 1), "</lastmod>")).otherwise("")
    entry = text("<url><loc>", F.col("entry_url"), "</loc>", lastmod, "</url>")
    chunk = F.col("d") % 4
    children = rows.groupBy("site_key", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("d", entry.alias("e")))).alias("entries")
    )
    children = children.select(
        text(origin, "/sitemap-", F.col("chunk"), ".xml").alias("url"),
        text("<?xml version='1.0'?><urlset>", F.array_join(F.transform("entries", lambda x: x["e"]), ""), "</urlset>").alias("body"),
    )
    listed = F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda c: text("<sitemap><loc>", origin, "/sitemap-", c, ".xml</loc></sitemap>")
    )
    where = F.when(F.col("sn") % 5 == 0, text(F.col("scope_root"), "/sitemap.xml")).otherwise(text(origin, "/sitemap-index.xml"))
    index = sites(spark, sf_dir).filter(F.col("sn") % 5 != 4).select(
        where.alias("url"), text("<sitemapindex>", F.array_join(listed, ""), "</sitemapindex>").alias("body")
    )
    return index.unionByName(children)


def llms_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site_key, url, content`` of two thirds of the sites."""
    link = lambda n: text("- [page](", F.col("scope_root"), "/extra-", F.lit(n), ".md)\n")
    spec = F.when(F.col("sn") % 4 == 1, text("- [api](https://", F.col("site_key"), "/specs/openapi-main.yaml)\n")).otherwise("")
    mcp = F.when(F.col("sn") % 6 == 1, text("- [mcp](https://", F.col("site_key"), "/agents/mcp)\n")).otherwise("")
    return sites(spark, sf_dir).filter(F.col("sn") % 3 != 0).select(
        "site_key", text("https://", F.col("site_key"), "/llms.txt").alias("url"),
        text("# ", F.col("s"), "\n\n> Docs\n\n## Pages\n", link(1), link(2), spec, mcp).alias("content"),
    )


def spec_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, status, truncated, body, final_url`` of API descriptions: JSON for some sites, YAML for others."""
    sn, key = F.col("sn"), F.col("site_key")
    json_url = text(F.col("scope_root"), "/openapi.json")
    yaml_url = text("https://", key, "/specs/openapi-main.yaml")
    rows = sites(spark, sf_dir)
    as_json = rows.filter(sn % 2 == 0).select(json_url.alias("url"), F.lit(SPEC_JSON).alias("body"), (sn % 10 == 8).alias("truncated"))
    as_yaml = rows.filter(sn % 4 == 1).select(yaml_url.alias("url"), F.lit(SPEC_YAML).alias("body"), F.lit(False).alias("truncated"))
    both = as_json.unionByName(as_yaml)
    return both.select("url", F.lit(200).alias("status"), "truncated", "body", F.col("url").alias("final_url"))


def interface_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers at the places where optional interfaces live."""
    sn, key, root = F.col("sn"), F.col("site_key"), F.col("scope_root")

    def rows(condition: Column, url: Column, status: int, kind: str, body: Column, auth: str | None = None) -> DataFrame:
        headers = F.create_map(F.lit("www-authenticate"), F.lit(auth).cast("string")) if auth else F.create_map().cast("map<string,string>")
        return sites(spark, sf_dir).filter(condition).select(
            url.alias("url"), F.lit(status).alias("status"), F.lit(kind).alias("content_type"), headers.alias("headers"),
            body.alias("body"), F.lit(False).alias("truncated"), url.alias("final_url"),
        )

    long_text = text("# Docs of ", F.col("s"), "\n", F.repeat(F.lit("word "), 100))
    return (
        rows(sn % 4 == 0, text("https://", key, "/llms-full.txt"), 200, "text/plain", long_text)
        .unionByName(rows(sn % 4 == 1, text(root, "/llms-full.txt"), 200, "text/html", long_text))
        .unionByName(rows(sn % 6 == 1, text("https://", key, "/agents/mcp"), 401, "text/plain", F.lit(""), "Bearer realm"))
        .unionByName(rows(sn % 6 == 2, text(root, "/mcp"), 200, "application/json", F.lit('{"jsonrpc":"2.0"}')))
        .unionByName(
            rows(sn % 6 == 4, text("https://", key, "/.well-known/mcp/server-card.json"), 200, "application/json", F.lit('{"name":"x","tools":[]}'))
        )
        .unionByName(
            rows(sn % 5 == 2, text("https://", key, "/.well-known/skills/index.json"), 200, "application/json", F.lit('{"skills":[{"a":1},{"b":2}]}'))
        )
        .unionByName(rows(sn % 5 == 3, text(root, "/.well-known/agent-skills/index.json"), 200, "application/json", F.lit("[]")))
    )


# --- answers -----------------------------------------------------------------------------------


def first_words(column: str, n: int) -> Column:
    """Words between the blanks of the SQL, which takes a vertical tab for no blank. Only the text up to the last of them is read."""
    head = F.regexp_extract(column, rf"^[\t\n\f\r ]*+(?:[^\t\n\f\r ]++[\t\n\f\r ]*+){{0,{n}}}", 0)
    return F.slice(F.split(F.trim(F.regexp_replace(head, r"[\t\n\f\r ]+", " ")), " "), 1, n)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per document; its quote is the document's first 15 words, some of them changed."""
    d = F.col("d")
    changed = F.when(d % 4 == 1, 2).when(d % 4 == 2, 3).otherwise(0)
    quote = F.array_join(
        F.transform(first_words("text", 15), lambda w, i: F.when(i < changed, "zzzz").otherwise(w)), " "
    )
    facts = F.when(d % 19 == 0, F.array().cast("array<string>")).otherwise(first_words("text", 3))
    return docs(spark, sf_dir).select(
        "site_key", d.alias("candidate_ord"), d.alias("question_ord"),
        text("What about topic ", d % 37, "? ").alias("question"), F.col("url").alias("source_url"),
        facts.alias("answer_facts"), quote.alias("evidence_quote"),
    )


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        "site_key", "url", text("Page ", F.col("d")).alias("title"), "text", (F.col("d") % 10 == 9).alias("needs_javascript")
    )


def agent_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry page, the answer's page (cut short for some) and sometimes a page that repeats its text."""
    d = F.col("d")
    limit = (d % 5) * 400 + 300
    status = F.when(d % 7 == 3, 404).when(d % 7 == 4, None).otherwise(200)
    cut = F.when(d % 7 == 4, "").otherwise(F.left("text", limit))

    def fetch(ordinal: int, url: Column, code: Column, body: Column, truncated: Column, full: Column) -> Column:
        return F.struct(
            F.lit(ordinal).alias("fetch_ord"), url.alias("url"), code.cast("int").alias("status"), body.alias("agent_text"),
            truncated.alias("truncated"), full.cast("bigint").alias("full_length"),
        )

    entry = fetch(0, F.col("scope_root"), F.lit(200), F.lit("Welcome"), F.lit(False), F.lit(7))
    page = fetch(1, text(F.col("url"), ".md"), status, cut, (F.length("text") > limit) & (d % 7 != 4), F.length("text"))
    other = fetch(2, text(F.col("scope_root"), "/page-", d + 20), F.lit(200), text("Copy: ", F.col("text")), F.lit(False), F.length("text"))
    made = F.array_compact(F.array(entry, F.when(d % 6 != 5, page), F.when(d % 12 == 5, other)))
    return docs(spark, sf_dir).select("site_key", d.alias("question_ord"), F.explode(made).alias("f")).select(
        "site_key", "question_ord", "f.*"
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    said = F.when(d % 9 == 0, "").when(d % 9 == 1, "Not found in the docs.").otherwise(
        text("It is so. See ", F.col("url"), ", https://", F.col("site_key"), "/docs/ and ", F.col("url"), ".")
    )
    verdict = F.when(d % 9 <= 1, None).when(d % 9 <= 3, "incorrect").when(d % 9 == 4, None).otherwise("correct")
    return docs(spark, sf_dir).select(
        "site_key", d.alias("question_ord"), said.alias("answer"),
        F.when(d % 23 == 22, "timeout").alias("operational_error"), verdict.alias("judge_verdict"),
        F.lit(" The number differs. ").alias("judge_reason"), (d % 2 == 0).alias("judge_supported"),
    )


# --- scores ------------------------------------------------------------------------------------


def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check rows from orders, one for each: the site is the customer, credit comes from the order's largest discount."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("top"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    group = F.when(F.col("o_orderstatus") == "F", "access").when(F.col("o_orderstatus") == "O", "freshness").otherwise("answerability")
    category = F.when(group == "freshness", F.when(k % 3 == 0, "currency").otherwise("maintenance")).otherwise("crawler-access")
    digit = F.left("o_orderpriority", F.lit(1))
    status = F.when(digit == "1", "fail").when(digit == "2", "warn").when(digit == "3", "pass").when(digit == "4", "skip").otherwise("unverified")
    top = F.when(k % 4 == 0, 10.0).when(k % 4 == 1, 7.0).when(k % 4 == 2, 4.0).otherwise(2.0)
    credit = F.least(F.lit(1.0), F.coalesce("top", F.lit(0.0)) * 10)
    earned = F.when(digit < "4", F.floor(top * credit * 10 + 0.5) / 10)
    return rows.select(
        F.col("o_custkey").cast("string").alias("site_key"), k.alias("check_ord"), text("check-", k).alias("id"),
        group.alias("group"), category.alias("category"), text("Check ", k).alias("title"), status.alias("status"),
        F.lit("native").alias("source"), top.alias("max"), earned.alias("earned"), text("Order ", k).alias("message"),
        F.when(k % 5 != 0, text("Fix ", k)).alias("fix"), F.lit(None).cast("array<string>").alias("evidence"),
    )


def site_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site_key, pages_tested, rate_limited`` per customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("site_key"), (k % 9 + 1).alias("pages_tested"), F.when(k % 7 == 0, k % 4).otherwise(0).alias("rate_limited")
    )


def site_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(k % 3 == 0).select(
        k.cast("string").alias("site_key"), F.when(k % 2 == 0, 39).otherwise(59).alias("cap_value"),
        F.lit("llms-txt-exists").alias("cap_check"), F.lit("No llms.txt found.").alias("cap_reason"),
    )


def answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("site_key"),
        F.when(k % 5 == 0, "pending").when(k % 5 == 1, "unavailable").otherwise("complete").alias("state"),
        F.when(k % 5 == 1, "No model.").alias("reason"),
    )


def agent_docs_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the 23 results per line item. The site is the order; where its lines give a check again, that is a second
    site of the order (``<order>#2``), and so on."""
    ids = F.array(*[F.lit(i) for i, _, _ in K.AGENT_DOCS_CHECKS])
    categories = F.array(*[F.lit(c) for _, _, c in K.AGENT_DOCS_CHECKS])
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    # The first three lines are the checks that matter to caps, the others go through all.
    place = F.when(n == 1, 0).when(n == 2, 9).when(n == 3, 21).otherwise(F.pmod(n * 3 + F.col("l_orderkey"), F.lit(23)).cast("int"))
    status = (
        F.when(q % 5 == 0, "fail").when(q % 5 == 1, "warn").when(q % 5 == 2, "pass").when(q % 5 == 3, "skip").otherwise("error")
    )
    share = F.col("l_discount") * 10
    mode = F.when(q % 11 == 0, "notApplicable").otherwise("numeric")
    url = lambda i: text("https://x.example.com/", F.col("l_partkey"), "/", F.lit(i))
    page = lambda i, s: F.struct(url(i).alias("url"), F.lit(s).alias("status"))
    found = F.array(page(1, "pass"), page(2, "fail"), page(3, "warn"), page(4, "fail"), page(5, "fail"))
    order = Window.partitionBy("l_orderkey", "place").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_discount", q)
    lines = table(spark, sf_dir, "lineitem").withColumn("place", place).withColumn("again", F.row_number().over(order))
    repeat = F.when(F.col("again") > 1, text("#", F.col("again"))).otherwise("")
    return lines.select(
        text(F.col("l_orderkey"), repeat).alias("site_key"), F.get(ids, F.col("place")).alias("id"), F.get(categories, F.col("place")).alias("category"),
        n.alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), status.alias("status"),
        text("Part ", F.col("l_partkey")).alias("message"),
        F.lit("Serve the page. Run with --fixes to see more. See the config file.").alias("resolution"),
        share.alias("proportion"), mode.alias("display_mode"), (share * 4).alias("earned"), F.lit(4.0).alias("max"),
        F.when(q % 2 == 0, found).alias("page_results"),
    )


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").filter(k % 10 < 2).select(
        k.cast("string").alias("site_key"), F.when(k % 10 == 0, "no-viable-path").otherwise("single-page-sample").alias("id")
    )


def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("site_key"), F.col("p_brand").alias("model"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("input_tokens"),
        F.floor("l_extendedprice").cast("bigint").alias("output_tokens"),
    )


BRAND_PRICES = {"Brand#11": (1.0, 5.0), "Brand#12": (2.0, 10.0), "Brand#13": (4.0, 20.0), "Brand#21": (1.0, 5.0), "Brand#22": (2.0, 8.0)}


def fetch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a fetch history: the user is the origin, an error is a refusal, the event id orders it."""
    kind, e = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        text("site-", F.col("user_id")).alias("site_key"), text("origin-", F.col("user_id")).alias("origin"),
        text("req-", F.floor(e / 2)).alias("request_id"), (e % 2).cast("int").alias("attempt"), e.alias("fetch_ord"),
        F.col("ts").alias("fetched_at"), text("https://o", F.col("user_id"), ".example.com/", e).alias("url"),
        F.when(kind == "error", F.when(e % 3 == 0, 503).otherwise(429)).when(kind == "signup", None).otherwise(200).cast("int").alias("status"),
        F.when(kind == "signup", F.when(e % 4 == 0, "robots").when(e % 4 == 1, "budget").otherwise("timeout")).alias("failure"),
    )
