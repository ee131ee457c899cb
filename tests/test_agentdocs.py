"""The 23 agent-docs checks over crawl tables: llms.txt checks, gating and dependency skips."""

from docgauge.operators import agentdocs as G


def test_native_results(spark):
    sites = spark.createDataFrame([("good",), ("bare",)], "site_key string")
    file = "# Acme\n\n> Docs\n\n## Pages\n- [a](https://g/docs/a.md)\n"
    llms = spark.createDataFrame([("good", 200, "text/plain; charset=utf-8", file), ("bare", 404, "text/html", "<html>")],
                                 "site_key string, status int, content_type string, content string")
    links = spark.createDataFrame([("good", "https://g/docs/a.md", 200, "text/html"), ("good", "https://g/docs/b", 404, None)],
                                  "site_key string, link string, status int, content_type string")
    pages = spark.createDataFrame([("good", "g/docs/a"), ("good", "g/docs/b"), ("good", "g/docs/c"), ("good", "g/docs/d"), ("bare", "b/x")], "site_key string, page_key string")
    probes = spark.createDataFrame([("good", "u1", "auth-gate-detection", True), ("bare", "u1", "auth-gate-detection", False), ("bare", "u2", "auth-gate-detection", True)],
                                   "site_key string, url string, id string, ok boolean")
    alternatives = spark.createDataFrame([("good",)], "site_key string")
    rows = G.native_results(sites, probes, G.llms_txt_probes(sites, llms, links, pages), alternatives)
    got = {(r.site_key, r.id): r for r in G.afdocs_checks(G.check_dependencies(rows)).collect()}
    assert len(got) == 46
    want = {
        ("good", "llms-txt-exists"): ("pass", 10.0), ("good", "llms-txt-valid"): ("pass", 4.0), ("good", "llms-txt-size"): ("pass", 7.0),
        ("good", "llms-txt-links-resolve"): ("warn", 3.5), ("good", "llms-txt-links-markdown"): ("warn", 3.5), ("good", "llms-txt-coverage"): ("warn", 2.0),
        ("good", "auth-gate-detection"): ("pass", 10.0), ("good", "auth-alternative-access"): ("skip", None),
        ("bare", "llms-txt-exists"): ("fail", 0.0), ("bare", "llms-txt-valid"): ("skip", None), ("bare", "llms-txt-coverage"): ("skip", None),
        ("bare", "auth-gate-detection"): ("warn", 5.0), ("bare", "auth-alternative-access"): ("fail", 0.0),
    }
    for key, (status, earned) in want.items():
        assert (got[key].status, got[key].earned) == (status, earned), key
    assert got[("bare", "auth-gate-detection")].evidence == ["u1"]


def test_first_robots_cause_stays_and_a_limit_outweighs_it(spark):
    from docgauge.operators import agentdocs as G

    rows = spark.createDataFrame([(k, "a", "fail", "m") for k in "xyz"], "site_key string, id string, status string, message string")
    cuts = [("x", "a", "robots_unreachable", 0), ("x", "a", "robots", 1), ("y", "a", "robots", 0), ("y", "a", "limit", 1), ("z", "a", "robots", 0), ("z", "a", "robots_unreachable", 1)]
    df = spark.createDataFrame(cuts, "site_key string, id string, cut_off string, cut_ord int")
    got = {r.site_key: r.message for r in G.cutoff_reclass(rows, df).collect()}
    assert "could not be read" in got["x"] and "limit" in got["y"] and "asked our scanner" in got["z"]
