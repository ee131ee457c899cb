"""Scores, caps, fixes and the final stage on small tables with known results."""

from docgauge import schemas as S
from docgauge.operators import agentdocs as G, answers as A, fixes as X, report as R, scoring
from docgauge.plans.final import finalize_report
from docgauge.streaming.monitor import refresh_touched

CATEGORY = {"links-and-anchors": ("freshness", "maintenance"), "update-info": ("freshness", "maintenance"), "api-spec-match": ("freshness", "consistency"),
            "deprecation-notices": ("freshness", "currency")}


def checks(spark, rows, site="s"):
    """Rows: (id, max, earned, status)."""
    made = []
    for i, (cid, top, earned, status) in enumerate(rows):
        group, category = CATEGORY.get(cid, ("access", "content-discoverability"))
        earned = None if earned is None else float(earned)
        made.append((site, i, cid, group, category, cid, status, "native", float(top), earned, "m", f"fix {cid}", None))
    return spark.createDataFrame(made, S.CHECK_RESULTS)


def coverage(spark, pages=15, limited=0, site="s"):
    return spark.createDataFrame([(site, pages, limited)], "site_key string, pages_tested int, rate_limited int")


def caps(spark, value=59):
    return spark.createDataFrame([("s", value, "llms-txt-exists", "None.")], "site_key string, cap_value int, cap_check string, cap_reason string")


def one(df):
    return df.collect()[0]


def test_points_become_a_score_with_groups(spark):
    rows = checks(spark, [("a", 10, 10, "pass"), ("b", 7, 3.5, "warn"), ("links-and-anchors", 6, 6, "pass"), ("update-info", 2, 0, "fail")])
    report = one(scoring.score_report(rows, coverage(spark)))
    assert (report.earned, report.possible, report.score, report.grade, report.cap) == (19.5, 25.0, 78, "C", None)
    groups = {g.group: g for g in report.groups}
    assert (groups["access"].earned, groups["access"].possible, groups["access"].score) == (13.5, 17.0, 79)
    assert groups["freshness"].score == 75 and groups["freshness"].note.startswith("Maintenance only")
    assert report.reason.startswith("19.5 of 25 possible points.")


def test_null_points_drop_out(spark):
    report = one(scoring.score_report(checks(spark, [("a", 10, 10, "pass"), ("b", 7, None, "skip"), ("c", 3, None, "unverified")]), coverage(spark)))
    assert (report.earned, report.possible, report.score) == (10.0, 10.0, 100)


def test_cap_applies_only_below_the_raw_score(spark):
    base = [("llms-txt-exists", 10, 0, "fail"), ("b", 7, 7, "pass"), ("links-and-anchors", 6, 6, "pass")]
    low = one(scoring.score_report(checks(spark, base), coverage(spark), caps(spark)))
    assert (low.score, low.cap) == (57, None)
    more = base + [("api-spec-match", 5, 5, "pass"), ("deprecation-notices", 5, 5, "pass")]
    held = one(scoring.score_report(checks(spark, more), coverage(spark), caps(spark)))
    assert held.score == 59 and held.cap.cap_value == 59 and "Held at 59" in held.reason


def test_nothing_counted(spark):
    report = one(scoring.score_report(checks(spark, [("a", 10, None, "skip")]), coverage(spark)))
    assert report.score is None and report.grade is None and report.provisional


def test_spec_checks_lift_the_maintenance_note(spark):
    report = one(scoring.score_report(checks(spark, [("links-and-anchors", 6, 6, "pass"), ("api-spec-match", 5, 4, "warn")]), coverage(spark)))
    freshness = [g for g in report.groups if g.group == "freshness"][0]
    assert (freshness.score, freshness.note) == (91, None)


def test_provisional_reasons(spark):
    rows = checks(spark, [("a", 10, None, "unverified"), ("b", 7, 7, "pass"), ("c", 2, None, "skip")])
    reasons = one(scoring.provisional_reasons(rows, coverage(spark, 3, 2))).reasons
    assert reasons == [
        "Only 3 pages could be read; a score needs at least 5.",
        "The site refused 2 requests as too many, so some checks may read low.",
        "1 of the 2 checks that apply could not be verified.",
    ]


def test_top_fixes(spark):
    rows = checks(spark, [("small", 4, 0, "fail"), ("big", 10, 5, "warn"), ("passing", 7, 7, "pass"), ("links-and-anchors", 6, 1.2, "fail")])
    fixes = [(f.check_id, f.points) for f in X.top_fixes(rows).orderBy("fix_ord").collect()]
    assert fixes == [("big", 5.0), ("links-and-anchors", 4.8), ("small", 4.0)]


def test_final_stage_leads_with_the_cause_of_misses(spark):
    technical = checks(spark, [("x", 10, 0, "fail"), ("y", 10, 10, "pass")])
    rollup = spark.createDataFrame(
        [("s", "complete", None, 6, 3, 3, 3, 3)],
        "site_key string, state string, reason string, total int, correct int, retrieved int, answered int, supported int",
    )
    entries = spark.createDataFrame(
        [("s", i, f"q{i}", "https://d.test/docs/a", "not-found", "The agent never reached /docs/a, the page with the answer.") for i in range(3)],
        "site_key string, question_ord int, question string, source_url string, verdict string, reason string",
    )
    all_checks, scores, fixes = finalize_report(technical, rollup, entries, coverage(spark, 6))
    score = one(scores)
    assert (score.earned, score.possible, score.score, score.grade) == (27.5, 48.0, 57, "F")
    answers = [g for g in score.groups if g.group == "answerability"][0]
    assert (answers.state, answers.earned, answers.possible) == ("complete", 17.5, 28.0)
    first = fixes.orderBy("fix_ord").collect()[0]
    assert (first.check_id, first.points) == ("answerability", 10.5)
    lost = {r.id: round(r.max - r.earned, 1) for r in all_checks.collect() if r.group == "answerability"}
    assert lost == {"evidence-retrieved": 3.5, "answers-correct": 7.0, "answers-supported": 0.0}

    sites = spark.createDataFrame(
        [("s", "https://d.test/docs", "D", "https://r.test/d", 6, "https://d.test/docs/a", "2026-09-23", "complete")],
        "site_key string, scope_root string, name string, report_url string, pages_tested int, first_page string, started_on string, answer_state string",
    )
    extras = spark.createDataFrame([("s", "mcp-server", "MCP", "missing", "None.", "Offer one.", None)],
                                   "site_key string, id string, title string, status string, message string, fix string, evidence array<string>")
    text = one(R.fix_prompt(sites, all_checks, extras, entries, fixes, scores)).fix_prompt
    order = [text.index(part) for part in ("## Failing checks (1)", "### 1. x", "## Partly passing checks (2)", "### 2. Agent answers real", "Questions an agent could not answer (3)", "### 4. MCP")]
    assert order == sorted(order)
    assert "57/100 (F), 27.5 of 48 points" in text and "worth 14 points, earned 7" in text


def test_caps(spark):
    def cap(rows, diagnostics=()):
        results = spark.createDataFrame(
            [("s", i, None, st, None, None, p, mode, None, 10.0, None) for i, st, p, mode in rows] or [("s", "other", None, "pass", None, None, 1.0, "numeric", None, 10.0, None)],
            S.AGENT_DOCS_RESULTS,
        )
        found = G.afdocs_cap(results, spark.createDataFrame([("s", d) for d in diagnostics], S.DIAGNOSTICS)).collect()
        return (found[0].cap_value, found[0].cap_check) if found else None

    missing = ("llms-txt-exists", "fail", 0.0, "numeric")
    assert cap([missing]) == (59, "llms-txt-exists")
    assert cap([missing, ("rendering-strategy", "fail", 0.2, "numeric"), ("auth-gate-detection", "warn", 0.5, "numeric")]) == (39, "rendering-strategy")
    assert cap([("llms-txt-exists", "pass", 1.0, "numeric"), ("rendering-strategy", "fail", 0.0, "notApplicable")]) is None
    assert cap([], ["single-page-sample"]) == (59, "single-page-sample")
    assert cap([], ["no-viable-path", "single-page-sample"]) == (39, "no-viable-path")


def test_cost(spark):
    usage = spark.createDataFrame([("a", "anthropic/claude-haiku-4.5", 1_000_000, 0), ("b", "unknown/model", 1_000_000, 0)], S.MODEL_USAGE)
    costs = {r.site_key: r.cost_usd for r in A.cost_per_run(usage, A.price_table(spark)).collect()}
    assert costs == {"a": 1.0, "b": 5.0}


def test_refresh_reads_only_touched_sites(spark):
    rows = checks(spark, [("a", 10, 10, "pass")]).unionByName(checks(spark, [("a", 10, 0, "fail")], "t"))
    cover = coverage(spark).unionByName(coverage(spark, site="t"))
    assert [(r.site_key, r.score) for r in refresh_touched(checks(spark, [("a", 1, 1, "pass")], "t"), rows, cover).collect()] == [("t", 0)]
