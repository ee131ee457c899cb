"""A small docs site end to end: captured tables in, all checks and a score out."""

from pyspark.sql import functions as F

from docgauge import constants as K, schemas as S
from docgauge.operators import identity as I, pages as P, platform
from docgauge.operators import answers as A
from docgauge.plans.final import final_report, technical_report
from docgauge.plans.technical import Captured, technical_findings, technical_scores, technical_stage
from docgauge.session import Scope
from docgauge.sources.sinks import ReportStore

ROOT = "https://docs.acme.test/docs"
SPEC = '{"paths":{"/v1/widgets":{"get":{}},"/v1/legacy-widgets":{"get":{"deprecated":true}}}}'
NAMES = ("install", "widgets", "keys", "limits", "errors", "legacy")


def page(name):
    links = "".join(f'<a href="{ROOT}/{n}#top">{n}</a>' for n in NAMES)
    extra = f'<a href="{ROOT}/missing-page">x</a><a href="#example">y</a>' if name == "install" else ""
    said = "Note: GET /v1/legacy-widgets is deprecated, use GET /v1/widgets instead." if name == "legacy" else "Call GET /v1/widgets today."
    return (f'<html><head><title>{name} | Acme Docs</title><meta name="generator" content="Docusaurus v3"><meta property="article:modified_time" content="2026-08-01"></head>'
            f'<body><div id="__docusaurus"><main><article><h1 id="{name}">{name}</h1><p>{said}</p>{links}{extra}</article></main></div></body></html>')


def captured(spark, **more):
    log = []

    def fetched(url, status, kind, body, method="GET", failure=None):
        log.append(("s", len(log), url, method, "*/*", status, kind, {}, body, url, False, False, failure, None))

    for n in NAMES:
        fetched(f"{ROOT}/{n}", 200, "text/html", page(n))
    fetched(f"{ROOT}/missing-page", 404, "text/html", None, "HEAD")
    fetched(f"{ROOT}/missing-page", 404, "text/html", "gone")
    fetched("https://docs.acme.test/sitemap.xml", 200, "application/xml",
            "<urlset>" + "".join(f"<url><loc>{ROOT}/{n}</loc><lastmod>2026-08-01</lastmod></url>" for n in NAMES) + "</urlset>")
    fetched(f"{ROOT}/openapi.json", 200, "application/json", SPEC)
    responses = spark.createDataFrame(log, S.RESPONSES)
    sites = spark.createDataFrame([("s", ROOT, "docs.acme.test", "developer-docs", None, None)], S.SITES)
    robots = spark.createDataFrame([("https://docs.acme.test", 200, "User-agent: *\nAllow: /\nSitemap: https://docs.acme.test/sitemap.xml")], S.ROBOTS_RESPONSES)
    llms = spark.createDataFrame([("s", "https://docs.acme.test/llms.txt", "".join(f"- [x]({ROOT}/{n}.md)\n" for n in NAMES))], "site_key string, url string, content string")
    pages = P.read_pages(responses).filter(~F.col("url").endswith("missing-page"))
    return Captured(sites, pages, responses, robots, llms, I.suffix_table(spark, K.PUBLIC_SUFFIXES, K.PRIVATE_SUFFIXES), **more)


def now():
    return F.lit("2026-09-30").cast("timestamp")


def test_site(spark):
    scope = Scope()
    taken = captured(spark)
    stage = technical_stage(taken, now(), scope)
    sites = taken.sites

    checks = {r.id: r for r in stage.checks.collect()}
    assert len(checks) == 7
    for check in ("api-spec-match", "deprecation-notices", "crawler-permissions", "update-info", "sitemap-live"):
        assert checks[check].status == "pass", checks[check]
    links = checks["links-and-anchors"]
    assert links.status == "fail" and any("/missing-page (404)" in e for e in links.evidence) and any("#example (no such section)" in e for e in links.evidence)
    # Every page found is listed but the missing one: 6 of 7.
    assert checks["sitemap-coverage"].status == "warn" and checks["sitemap-coverage"].evidence == [f"{ROOT}/missing-page"]
    assert stage.platforms.collect()[0].platform == "docusaurus"
    named = P.site_name(stage.facts, I.registrable(sites, "domain", I.suffix_table(spark, K.PUBLIC_SUFFIXES, K.PRIVATE_SUFFIXES))).collect()[0]
    assert named.name == "Acme"
    extras = {r.id: r.status for r in stage.extras.collect()}
    assert extras == {"mcp-server": "missing", "llms-full-txt": "missing", "agent-skills": "missing"}
    cover = spark.createDataFrame([("s", 6, 0)], "site_key string, pages_tested int, rate_limited int")
    report = technical_scores(stage, cover).collect()[0]
    assert report.possible == 29.0 and abs(report.earned - sum(c.earned for c in checks.values())) < 1e-9 and not report.provisional
    assert stage.coverage.collect()[0].asDict() == {"site_key": "s", "pages_discovered": 6, "pages_tested": 6, "requests": 10, "rate_limited": 0, "discovery_sources": ["llms.txt", "sitemap"]}
    scope.release()


def test_reports_are_written_read_back_and_settled(spark, tmp_path):
    """From captured tables to the stored report: technical first, then with answers, which replace it for readers."""
    results = [("s", i, c, "fail" if i == "cache-header-hygiene" else "pass", "ok", None, 1.0, "numeric", 4.0, 4.0, None) for i, _, c in K.AGENT_DOCS_CHECKS if i != "llms-txt-exists"]
    results.append(("s", "llms-txt-exists", "content-discoverability", "fail", "No file.", "Add one.", 0.0, "numeric", 0.0, 4.0, None))
    more = {
        "results": spark.createDataFrame(results, S.AGENT_DOCS_RESULTS), "diagnostics": spark.createDataFrame([], S.DIAGNOSTICS),
        "cutoffs": spark.createDataFrame([("s", "cache-header-hygiene", "robots")], "site_key string, id string, cut_off string"),
    }
    pending = spark.createDataFrame([("s", "pending", None)], "site_key string, state string, reason string")
    asked = [("s", q, f"Question {q}?", f"{ROOT}/keys", "x", "incorrect" if q < 3 else "correct", "The agent read /docs/keys but answered incorrectly: no." if q < 3 else "Answered.", None, True, q > 2, [f"{ROOT}/keys"], []) for q in range(6)]
    entries = spark.createDataFrame(asked, "site_key string, question_ord bigint, question string, source_url string, answer string, verdict string, reason string, cause string, retrieved boolean, supported boolean, pages_visited array<string>, cited_urls array<string>")
    with Scope() as scope:
        stage = technical_stage(captured(spark, **more), now(), scope)
        found = technical_findings(stage, "https://reports.test/{site}", "2026-09-30", pending, scope)
        first = technical_report(found, pending, scope)
        store = ReportStore.like(first, str(tmp_path / "technical"))
        assert store.write(first, K.METHODOLOGY_VERSION, 1) == 1
        last = final_report(found, A.answerability_rollup(found.sites, entries), entries, scope)
        final = ReportStore.like(last, str(tmp_path / "final"), "json")
        assert final.write(last, K.METHODOLOGY_VERSION, 2) == 1
    early = store.read().collect()[0]
    assert early.stage == "technical" and "still being tested" in early.fix_prompt and "Questions an agent" not in early.fix_prompt
    assert early.name == "Acme" and early.platform == "docusaurus" and early.pages_tested == 6 and early.first_page == f"{ROOT}/install"
    assert len(early.checks) == 30 and {c.id: c.status for c in early.checks}["cache-header-hygiene"] == "unverified"
    report = final.read(K.METHODOLOGY_VERSION).collect()[0]
    assert report.stage == "final" and len(report.checks) == 33 and len(report.transcript) == 6
    assert "## Questions an agent could not answer (3)" in report.fix_prompt and '- "Question 0?": The agent read' in report.fix_prompt
    assert report.top_fixes[0].check_id == "answerability" and report.top_fixes[0].title == "Agents could not answer 3 of 6 questions"
    assert report.limitations[0].startswith("Based on 6 sampled pages") and report.answerability.state == "complete"
    assert report.run == 2 and report.methodology_version == K.METHODOLOGY_VERSION


def test_pages_come_from_the_sample_and_the_platform_settles_the_profile(spark):
    taken = captured(spark)
    sample = [("s", i, f"{ROOT}/{n}", 40) for i, n in enumerate(NAMES[:5])]
    taken.sampled = spark.createDataFrame(sample, "site_key string, page_ord bigint, url string, total_pages bigint")
    generator = '<meta name="generator" content="Docusaurus v3">'
    zendesk = F.replace(F.col("html"), F.lit(generator), F.lit('<link href="https://static.zdassets.com/hc/assets/a.css"><meta name="x" content="zendesk">'))
    taken.pages = taken.pages.withColumn("html", zendesk)
    scope = Scope()
    stage = technical_stage(taken, now(), scope)
    assert stage.facts.count() == 5 and stage.coverage.collect()[0].pages_discovered == 40
    helped = stage.platforms.collect()[0].help_center
    assert stage.sites.collect()[0].profile == ("help-center" if helped else "developer-docs")
    chosen = spark.createDataFrame([("s", "developer-docs", True), ("t", "developer-docs", False)], "site_key string, profile string, profile_chosen boolean")
    detected = spark.createDataFrame([("s", True), ("t", True)], "site_key string, help_center boolean")
    assert {r.site_key: r.profile for r in platform.settle_profile(chosen, detected).collect()} == {"s": "developer-docs", "t": "help-center"}
