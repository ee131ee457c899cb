"""Queries over check results: scores, caps, fixes, notes, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docgauge import constants as K, schemas as SCHEMAS
from docgauge.functions import urls as U
from docgauge.functions.numbers import grade_for, status_for_credit
from docgauge.operators import agentdocs as G, answers as A, crawl, fixes as X, report as R, scoring as S
from docgauge.operators.common import first_n, ordered_texts
from docgauge.plans.final import Findings, final_report, finalize_report
from docgauge.session import shared_folder, stored
from docgauge.sources.llms import llms_links
from docgauge.sources.sinks import ReportStore
from docgauge.streaming.monitor import stream_report_upsert, upsert_into
from workload import captures as C
from workload.queries_sites import label_rollup, labelled
from workload.registry import CHECKS, DOCS, GRADE, REASONS, query, scope

_PCT = "CASE WHEN possible > 0 THEN CAST(floor(earned / possible * 100 + 0.5::DOUBLE) AS INT) END"


@query("grade_for", f"SELECT o_orderkey, {GRADE} AS grade FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 103 <= 100 THEN o_orderkey % 103 END AS score FROM orders)")
def _grade_for(spark, sf):
    score = F.when(F.col("o_orderkey") % 103 <= 100, F.col("o_orderkey") % 103)
    return C.table(spark, sf, "orders").select("o_orderkey", grade_for(score).alias("grade"))


@query(
    "status_for_credit",
    "SELECT l_orderkey, l_discount, count(*) AS n, CASE WHEN l_discount * 10 >= 0.8 THEN 'pass' WHEN l_discount * 10 >= 0.5 THEN 'warn' ELSE 'fail' END AS status FROM lineitem GROUP BY 1, 2",
)
def _status_for_credit(spark, sf):
    rows = C.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_discount").agg(F.count("*").alias("n"))
    return rows.withColumn("status", status_for_credit(F.col("l_discount") * 10, 0.8, 0.5))


@query("counted_checks", f"WITH {CHECKS} SELECT site_key, k AS check_ord, earned FROM checks WHERE earned IS NOT NULL")
def _counted(spark, sf):
    return S.counted_checks(C.check_results(spark, sf)).select("site_key", "check_ord", "earned")


_CAPPED = f"""
raw AS (SELECT t.*, {_PCT} AS raw, cov.*  EXCLUDE (site_key) FROM totals t LEFT JOIN cov USING (site_key)),
scored AS (SELECT *, CASE WHEN c % 3 = 0 THEN CASE WHEN c % 2 = 0 THEN 39 ELSE 59 END END AS cap FROM raw),
overall AS (SELECT *, CASE WHEN cap < raw THEN cap ELSE raw END AS score, coalesce(cap < raw, FALSE) AS capped FROM scored)
"""


@query("overall_score", f"WITH {CHECKS}, {_CAPPED} SELECT site_key, earned, possible, score, capped, {GRADE} AS grade FROM overall")
def _overall(spark, sf):
    return S.overall_score(C.check_results(spark, sf), C.site_caps(spark, sf))


_GROUPS = f"""
gt AS (SELECT site_key, grp, floor(coalesce(sum(earned), 0) * 10 + 0.5::DOUBLE) / 10 AS earned,
  floor(coalesce(sum(CASE WHEN earned IS NOT NULL THEN max END), 0) * 10 + 0.5::DOUBLE) / 10 AS possible FROM checks GROUP BY 1, 2),
st AS (SELECT CAST(c_custkey AS VARCHAR) AS site_key, CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'unavailable' ELSE 'complete' END AS state FROM customer),
grid AS (SELECT site_key, g, has_currency FROM totals, (SELECT unnest(['access', 'freshness', 'answerability']) AS g)),
gs AS (SELECT grid.site_key, g, has_currency, CASE WHEN g = 'answerability' AND st.state <> 'complete' THEN 0.0::DOUBLE ELSE coalesce(earned, 0) END AS earned,
  CASE WHEN g = 'answerability' AND st.state <> 'complete' THEN 0.0::DOUBLE ELSE coalesce(possible, 0) END AS possible, st.state AS st
  FROM grid LEFT JOIN gt ON grid.site_key = gt.site_key AND grid.g = gt.grp LEFT JOIN st ON st.site_key = grid.site_key),
gf AS (SELECT site_key, g AS "group", earned, possible, {_PCT} AS score,
  CASE WHEN g = 'answerability' AND st <> 'complete' THEN st WHEN possible = 0 THEN 'unavailable' ELSE 'complete' END AS state,
  CASE WHEN g = 'freshness' AND possible = 0 THEN 'No freshness check could run on this site.'
    WHEN g = 'freshness' AND NOT has_currency THEN 'Maintenance only: no API spec was found, so nothing here verifies that the content is current.'
    WHEN g = 'answerability' AND st = 'pending' THEN 'An agent is answering questions from these pages now; this part is added when it finishes.'
    WHEN g = 'answerability' AND st = 'unavailable' THEN 'No model.' WHEN g <> 'freshness' AND possible = 0 THEN 'None of the access checks could run.' END AS note FROM gs)
"""


@query("group_score", f'WITH {CHECKS}, {_GROUPS} SELECT site_key, "group", earned, possible, score, state, note FROM gf')
def _group(spark, sf):
    return S.group_score(C.check_results(spark, sf), C.answer_states(spark, sf)).drop("group_ord", "label")


@query(
    "score_rollup",
    f"""WITH {CHECKS}, f AS (SELECT site_key, grp, category, status, earned IS NOT NULL AS c, CASE WHEN earned IS NOT NULL THEN CAST(floor(earned * 10 + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS e,
      CASE WHEN earned IS NOT NULL THEN CAST(floor(max * 10 + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS p FROM checks),
    u AS (SELECT 3 - bit_count(GROUPING(site_key, grp, category)) AS level, site_key, grp, category, count(*) AS checks, sum(c::INT)::BIGINT AS counted,
      sum((status = 'unverified')::INT)::BIGINT AS unverified, sum(e)::BIGINT AS e, sum(p)::BIGINT AS p FROM f GROUP BY ROLLUP (site_key, grp, category))
    SELECT CAST(level AS INT) AS level, site_key, grp AS "group", category, checks, counted, unverified, e::DOUBLE / 10 AS earned, p::DOUBLE / 10 AS possible,
      CASE WHEN p > 0 THEN CAST((200 * e + p) // (2 * p) AS INT) END AS score FROM u""",
)
def _score_rollup(spark, sf):
    return S.score_rollup(C.check_results(spark, sf))


@query("provisional_reasons", f"WITH {CHECKS}, r AS (SELECT t.site_key, {REASONS} AS rs FROM totals t JOIN cov USING (site_key)) SELECT site_key, array_to_string(rs, ' ') AS reasons FROM r")
def _provisional(spark, sf):
    return S.provisional_reasons(C.check_results(spark, sf), C.site_coverage(spark, sf)).select("site_key", F.array_join("reasons", " ").alias("reasons"))


_REPORT = f"""
rep AS (SELECT o.*, st.state, gf.note AS fresh, CASE WHEN possible = 0 THEN ['None of the checks could run, so there is nothing to score.'] ELSE {REASONS} END AS rs
  FROM overall o JOIN st USING (site_key) JOIN (SELECT site_key, note FROM gf WHERE "group" = 'freshness') gf USING (site_key))
"""
_SCORE_REPORT = f"""WITH {CHECKS}, {_CAPPED}, {_GROUPS}, {_REPORT}"""


def scores(spark, sf):
    return S.score_report(C.check_results(spark, sf), C.site_coverage(spark, sf), C.site_caps(spark, sf), C.answer_states(spark, sf))


@query(
    "score_report",
    f"""{_SCORE_REPORT} SELECT site_key, score, {GRADE} AS grade, len(rs) > 0 AS provisional, CASE WHEN possible = 0 THEN 'None of the checks could run, so there is no score.' ELSE
    array_to_string(list_filter([regexp_replace(CAST(earned AS VARCHAR), '\\.0$', '') || ' of ' || regexp_replace(CAST(possible AS VARCHAR), '\\.0$', '') || ' possible points.',
      CASE WHEN state = 'pending' THEN 'Answerability is still being tested and will be added when it finishes.' END, fresh,
      CASE WHEN capped THEN 'Held at ' || cap || ' by a cap: No llms.txt found.' END], lambda x: x IS NOT NULL), ' ') END AS reason FROM rep""",
)
def _score_report(spark, sf):
    return scores(spark, sf).select("site_key", "score", "grade", "provisional", "reason")


@query("leaderboard", f"{_SCORE_REPORT} SELECT site_key, score, rank() OVER (ORDER BY score DESC) AS rank FROM rep WHERE len(rs) = 0 AND score IS NOT NULL")
def _leaderboard(spark, sf):
    reports = scores(spark, sf).withColumn("methodology_version", F.lit(K.METHODOLOGY_VERSION))
    return S.leaderboard(reports).select("site_key", "score", "rank")


@query(
    "stream_report_upsert",
    f"""{_SCORE_REPORT} SELECT site_key, score, len(rs) > 0 AS provisional FROM rep WHERE site_key IN (SELECT site_key FROM checks WHERE k % 50 = 0)""",
)
def _refresh(spark, sf):
    """The stream itself: results arrive as files, one a batch, and the touched sites' reports are upserted into a store. The stream runs
    twice from one checkpoint and once more from a new one, which repeats all its batches."""
    folder = f"{shared_folder(spark)}/docgauge-{spark.sparkContext.applicationId}/upsert-{uuid.uuid4().hex}"
    C.check_results(spark, sf).write.parquet(f"{folder}/checks")
    known = spark.read.schema(SCHEMAS.CHECK_RESULTS).parquet(f"{folder}/checks")
    known.filter(F.col("check_ord") % 50 == 0).repartition(4, "check_ord").write.parquet(f"{folder}/arriving")
    reports = scores(spark, sf)
    store = ReportStore.like(reports, f"{folder}/reports")
    for checkpoint in ("first", "first", "again"):
        arriving = spark.readStream.schema(SCHEMAS.CHECK_RESULTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
        stream_report_upsert(
            arriving, lambda: known, lambda: C.site_coverage(spark, sf), upsert_into(store, K.METHODOLOGY_VERSION), f"{folder}/checkpoint-{checkpoint}",
            C.answer_states(spark, sf), C.site_caps(spark, sf),
        ).awaitTermination()
    return store.read(K.METHODOLOGY_VERSION).select("site_key", "score", "provisional")


_FIX = """
open AS (SELECT *, floor((max - earned) * 10 + 0.5::DOUBLE) / 10 AS points FROM checks WHERE status IN ('fail', 'warn') AND fix IS NOT NULL AND earned IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY points DESC, CASE WHEN status = 'fail' THEN 0 ELSE 1 END, k) AS fix_ord FROM open WHERE points > 0
  QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY points DESC, CASE WHEN status = 'fail' THEN 0 ELSE 1 END, k) <= 3)
"""


@query("top_fixes", f"WITH {CHECKS}, {_FIX} SELECT site_key, fix_ord, 'check-' || k AS check_id, 'Check ' || k AS title, fix, points FROM top")
def _top_fixes(spark, sf):
    return X.top_fixes(C.check_results(spark, sf))


@query(
    "fix_order",
    f"""WITH {CHECKS}, {_FIX} SELECT c.site_key, c.k AS check_ord, row_number() OVER (PARTITION BY c.site_key ORDER BY coalesce(t.fix_ord, 99),
      CASE WHEN t.fix_ord IS NULL THEN -(c.max - coalesce(c.earned, 0)) ELSE 0 END, c.k) AS problem_ord
    FROM checks c LEFT JOIN top t ON c.site_key = t.site_key AND c.k = t.k WHERE c.status IN ('fail', 'warn')""",
)
def _fix_order(spark, sf):
    checks = C.check_results(spark, sf)
    return X.fix_order(checks, X.top_fixes(checks)).select("site_key", "check_ord", "problem_ord")


@query(
    "evidence_topk",
    f"""WITH {CHECKS} SELECT site_key, string_agg('Order ' || k, ', ' ORDER BY k) AS evidence FROM (SELECT * FROM checks WHERE status = 'fail'
    QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY k) <= 5) GROUP BY 1""",
)
def _evidence_topk(spark, sf):
    failing = first_n(C.check_results(spark, sf).filter(F.col("status") == "fail"), ["site_key"], ["check_ord"], 5)
    rows = failing.groupBy("site_key").agg(ordered_texts(F.col("check_ord"), F.col("message"), F.lit(True), 5).alias("evidence"))
    return rows.select("site_key", F.array_join("evidence", ", ").alias("evidence"))


# --- the 23 agent-docs checks ------------------------------------------------------------------

_IDS = "[" + ", ".join(f"'{i}'" for i, _, _ in K.AGENT_DOCS_CHECKS) + "]"
_RESULTS = f"""
ids AS (SELECT {_IDS} AS ids),
placed AS (SELECT *, CAST(CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 9 WHEN 3 THEN 21 ELSE (l_linenumber * 3 + l_orderkey) % 23 END AS INT) AS place FROM lineitem),
again AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, place ORDER BY l_partkey, l_suppkey, l_linenumber, l_discount, CAST(l_quantity AS INT)) AS again FROM placed),
r0 AS (SELECT l_orderkey || CASE WHEN again > 1 THEN '#' || again ELSE '' END AS site_key, ids[1 + place] AS id,
  l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS INT) AS q, l_discount * 10 AS share, l_orderkey AS k FROM again, ids),
r AS (SELECT *, CASE q % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' WHEN 2 THEN 'pass' WHEN 3 THEN 'skip' ELSE 'error' END AS status, q % 11 = 0 AS thin FROM r0)
"""


def results(spark, sf):
    return C.agent_docs_results(spark, sf)


@query(
    "afdocs_checks",
    f"""WITH {_RESULTS} SELECT site_key, id, CASE WHEN thin OR status = 'error' THEN 'unverified' ELSE status END AS status,
    CASE WHEN NOT thin AND status NOT IN ('error', 'skip') THEN floor(share * 4 * 10 + 0.5::DOUBLE) / 10 END AS earned,
    CASE WHEN thin THEN 'Too few pages were read to score this. ' ELSE '' END || 'Part ' || part AS message,
    CASE WHEN status <> 'pass' THEN 'Serve the page.' END AS fix,
    CASE WHEN status <> 'pass' AND q % 2 = 0 THEN 'https://x.example.com/' || part || '/2 https://x.example.com/' || part || '/3 https://x.example.com/' || part || '/4' END AS evidence FROM r""",
)
def _afdocs_checks(spark, sf):
    return G.afdocs_checks(results(spark, sf)).select("site_key", "id", "status", "earned", "message", "fix", F.array_join("evidence", " ").alias("evidence"))


_CAPS = """
caps AS (SELECT site_key, 59 AS v, 0 AS o, id FROM r WHERE id = 'llms-txt-exists' AND status = 'fail'
  UNION ALL SELECT site_key, CASE WHEN share <= 0.25 THEN 39 ELSE 59 END, CASE id WHEN 'rendering-strategy' THEN 1 ELSE 2 END, id FROM r
    WHERE id IN ('rendering-strategy', 'auth-gate-detection') AND NOT thin AND share <= 0.5
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 39, 3, 'no-viable-path' FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 59, 4, 'single-page-sample' FROM orders WHERE o_orderkey % 10 = 1),
lowest AS (SELECT site_key, v AS cap_value, id AS cap_check FROM caps QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY v, o) = 1)
"""


@query("afdocs_cap", f"WITH {_RESULTS}, {_CAPS} SELECT site_key, cap_value, cap_check FROM lowest")
def _afdocs_cap(spark, sf):
    return G.afdocs_cap(results(spark, sf), C.diagnostics(spark, sf)).select("site_key", "cap_value", "cap_check")


@query(
    "afdocs_summary",
    f"""WITH {_RESULTS}, {_CAPS} SELECT site_key, sum((status = 'pass')::INT) AS passed, count(*) AS total,
    floor(sum(CASE WHEN NOT thin THEN share * 4 END) * 10 + 0.5::DOUBLE) / 10 AS earned, floor(sum(CASE WHEN NOT thin THEN 4.0::DOUBLE END) * 10 + 0.5::DOUBLE) / 10 AS possible, any_value(cap_value) AS cap_value
    FROM r LEFT JOIN lowest USING (site_key) GROUP BY 1 HAVING sum((NOT thin)::INT) > 0""",
    whole=('passed',),
)
def _afdocs_summary(spark, sf):
    rows = results(spark, sf)
    return G.afdocs_summary(rows, G.afdocs_cap(rows, C.diagnostics(spark, sf))).drop("cap_check", "cap_reason")


@query(
    "result_status_counts",
    f"""WITH {_RESULTS} SELECT site_key, count(*) AS total, sum((status = 'pass')::INT) AS n_pass, sum((status = 'warn')::INT) AS n_warn, sum((status = 'fail')::INT) AS n_fail,
    sum((status = 'skip')::INT) AS n_skip, sum((status = 'error')::INT) AS n_error FROM r GROUP BY 1""",
    whole=('n_pass', 'n_warn', 'n_fail', 'n_skip', 'n_error'),
)
def _status_counts(spark, sf):
    return G.result_status_counts(results(spark, sf))


@query(
    "cutoff_reclass",
    f"""WITH {_RESULTS} SELECT site_key, id, CASE WHEN k % 3 <> 2 AND status IN ('fail', 'warn') THEN 'error' ELSE status END AS status,
    CASE WHEN k % 3 <> 2 AND status IN ('fail', 'warn') THEN 'Not finished: ' || CASE k % 3 WHEN 0 THEN 'the scan reached its time or request limit before this check could read everything it needed'
      ELSE 'robots.txt asked our scanner not to read some pages this check needed, and we follow it' END || ', so it is left out of the score. (Part ' || part || ')' ELSE 'Part ' || part END AS message FROM r""",
)
def _cutoff(spark, sf):
    rows = results(spark, sf)
    k = F.split_part("site_key", F.lit("#"), F.lit(1)).cast("bigint")
    cuts = rows.filter(k % 3 != 2).select("site_key", "id", F.explode(F.when(k % 3 == 0, F.array(F.lit("limit"), F.lit("robots"))).otherwise(F.array(F.lit("robots")))).alias("cut_off"))
    return G.cutoff_reclass(rows, cuts).select("site_key", "id", "status", "message")


@query(
    "check_dependencies",
    f"""WITH {_RESULTS}, last AS (SELECT k, id, last(status ORDER BY line, part, supp, status) AS status FROM r GROUP BY 1, 2),
    p AS (SELECT k, max(CASE WHEN id = 'llms-txt-exists' THEN status END) AS a, max(CASE WHEN id = 'rendering-strategy' THEN status END) AS b,
      max(CASE WHEN id = 'auth-gate-detection' THEN status END) AS c, max(CASE WHEN id = 'tabbed-content-serialization' THEN status END) AS d FROM last GROUP BY 1),
    -- rendering needs llms.txt; tabs need (rendering or the login check), seeing a skip of rendering; of a check's rows the last counts
    s AS (SELECT *, b IS NOT NULL AND a IS NOT NULL AND a NOT IN ('pass', 'warn') AS cut_b FROM p),
    t AS (SELECT *, (b IS NOT NULL OR c IS NOT NULL) AND NOT coalesce(NOT cut_b AND b IN ('pass', 'warn'), FALSE) AND NOT coalesce(c IN ('pass', 'warn'), FALSE) AS cut_d FROM s)
    SELECT CAST(k AS VARCHAR) AS site_key, r.id, r.line, r.part, CASE WHEN (r.id = 'rendering-strategy' AND cut_b) OR (r.id = 'tabbed-content-serialization' AND cut_d) THEN 'skip' ELSE r.status END AS status
    FROM r JOIN t USING (k)""",
)
def _dependencies(spark, sf):
    rules = (("rendering-strategy", (("llms-txt-exists",),)), ("tabbed-content-serialization", (("rendering-strategy", "auth-gate-detection"),)))
    # Every result of an order belongs to one site, so that checks repeat.
    rows = results(spark, sf).withColumn("site_key", F.split_part("site_key", F.lit("#"), F.lit(1)))
    return G.check_dependencies(rows, rules, ["line", "part", "supp"]).select("site_key", "id", "line", "part", "status")


def probe_pages(spark, sf):
    """Derived pages with the answers the page-level checks look at."""
    d = F.col("page_ord")
    return C.pages(spark, sf).select(
        "site_key", "page_ord", "url", "html", F.when(d % 11 == 0, 401).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.when(d % 13 == 0, "https://elsewhere.example.net/x").otherwise(F.col("url")).alias("final_url"),
        F.when(d % 4 == 0, "public, max-age=999999").when(d % 4 == 1, "max-age=60").alias("cache_control"),
        F.when(d % 2 == 0, 200).otherwise(404).alias("md_status"), F.lit("text/markdown").alias("md_type"),
        F.concat(F.when(d % 4 == 0, "See /llms.txt\n").otherwise(""), F.when(d % 3 == 0, "```\ncode\n").otherwise("plain\n")).alias("md_body"),
        F.when(d % 5 == 0, "text/markdown; charset=utf-8").otherwise("text/html").alias("negotiated_type"),
        F.when(d % 7 == 0, 200).otherwise(404).alias("probe_status"),
    )


def _share(check: str, ok: str, applies: str = "TRUE") -> str:
    return f"SELECT site_key, '{check}' AS id, avg(CASE WHEN {applies} THEN ({ok})::INT::DOUBLE END) AS share FROM docs GROUP BY 1"


_PROBES = " UNION ALL ".join(
    [
        _share("llms-txt-directive-html", "FALSE", "d % 11 <> 0"), _share("llms-txt-directive-md", "d % 4 = 0", "d % 2 = 0"),
        _share("markdown-url-support", "d % 2 = 0", "d % 11 <> 0"), _share("content-negotiation", "d % 5 = 0", "d % 11 <> 0"),
        _share("page-size-markdown", "TRUE", "d % 2 = 0"), _share("markdown-code-fence-validity", "d % 3 <> 0", "d % 2 = 0"),
        _share("http-status-codes", "d % 7 <> 0"), _share("redirect-behavior", "d % 13 <> 0"), _share("cache-header-hygiene", "d % 4 <> 0", "d % 11 <> 0"),
        _share("auth-gate-detection", "d % 11 <> 0"),
    ]
)


@query("agent_docs_page_probes", f"WITH {DOCS}, s AS ({_PROBES}) SELECT site_key, id, floor(share * 1000 + 0.5::DOUBLE) / 1000 AS share FROM s")
def _page_probes(spark, sf):
    shown = [c for c in G._PAGE_CHECKS if f"'{c}'" in _PROBES]
    probes = G.page_probes(probe_pages(spark, sf)).filter(F.col("id").isin(*shown))
    rows = probes.groupBy("site_key", "id").agg(F.avg(F.col("ok").cast("double")).alias("share"))
    return rows.select("site_key", "id", (F.floor(F.col("share") * 1000 + 0.5) / 1000).alias("share"))


@query("agent_docs_native")
def _native(spark, sf):
    sites = C.sites(spark, sf)
    answered = C.llms_txt(spark, sf).withColumns({"status": F.lit(200), "content_type": F.lit("text/plain")})
    links = llms_links(C.llms_txt(spark, sf)).select(
        "site_key", "link", F.when(F.endswith("link", F.lit("1.md")), 404).otherwise(200).alias("status"), F.lit("text/markdown").alias("content_type")
    )
    pages = C.pages(spark, sf).select("site_key", U.page_key(F.col("url")).alias("page_key"))
    llms = G.llms_txt_probes(sites, answered, links, pages)
    with_full = sites.filter(F.col("sn") % 4 == 0).select("site_key")
    rows = G.native_results(sites, G.page_probes(probe_pages(spark, sf)), llms, with_full)
    return G.afdocs_checks(G.check_dependencies(rows)).select("site_key", "id", "status", "earned", "message")


# --- notes, coverage, reports ------------------------------------------------------------------


@query(
    "coverage",
    """WITH p AS (SELECT 'site-' || user_id AS site_key, count(*) AS pages_tested, max(event_id % 50) AS pages_discovered,
      array_to_string(list_sort(list_distinct(array_agg(event_type))), ',') AS discovery_sources FROM events GROUP BY 1) SELECT * FROM p""",
)
def _coverage(spark, sf):
    history = C.fetch_history(spark, sf)
    sample = history.select("site_key", (F.col("fetch_ord") % 50).alias("total_pages"))
    sources = C.table(spark, sf, "events").select(C.text("site-", F.col("user_id")).alias("site_key"), F.col("event_type").alias("source"))
    rows = crawl.coverage(sample, crawl.fetch_stats(history), sources)
    return rows.select("site_key", "pages_tested", "pages_discovered", F.array_join("discovery_sources", ",").alias("discovery_sources"))


_NOTES = f"""
lim AS (SELECT site_key, list_filter(['Based on ' || pages_tested || ' sampled page' || CASE WHEN pages_tested = 1 THEN '' ELSE 's' END || ', chosen deterministically from the sitemap and llms.txt. Pages outside the sample were not read.',
  'Pages were fetched without running JavaScript, the way most AI agents read the web.',
  CASE WHEN c % 8 = 0 THEN 'The submitted URL routes content after "#/", which agents cannot follow, so only the landing page was reachable.' END,
  CASE WHEN c % 3 > 0 THEN 'robots.txt stopped the scanner from reading ' || (c % 3) || ' URL' || CASE WHEN c % 3 = 1 THEN '' ELSE 's' END || '; checks that needed them are unverified.' END,
  CASE WHEN unverified > 0 THEN 'Some checks could not be verified (a timeout, a blocked request or a scan limit); they are left out of the score rather than counted as failures.' END,
  CASE WHEN len(rs) > 0 THEN 'The score is provisional: ' || array_to_string(rs, ' ') END], lambda x: x IS NOT NULL) AS notes, rs, state FROM rep)
"""


def technical_notes(spark, sf):
    k = F.col("c_custkey")
    customers = C.table(spark, sf, "customer").select(k.cast("string").alias("site_key"), (k % 8 == 0).alias("hash_routed"), (k % 3).alias("robots_blocked"))
    checks = C.check_results(spark, sf)
    scored = scores(spark, sf)
    rows = crawl.limitations(customers, C.site_coverage(spark, sf), customers, checks, scored)
    return rows.join(scored.select("site_key"), "site_key", "left_semi"), scored


@query("limitations", f"{_SCORE_REPORT}, {_NOTES} SELECT site_key, array_to_string(notes, ' ') AS limitations FROM lim")
def _limitations(spark, sf):
    return technical_notes(spark, sf)[0].select("site_key", F.array_join("limitations", " ").alias("limitations"))


@query(
    "final_limitations",
    f"""{_SCORE_REPORT}, {_NOTES} SELECT site_key, array_to_string(list_concat(notes, CASE WHEN state = 'unavailable' THEN ['No model.'] ELSE [] END), ' ') AS limitations FROM lim""",
)
def _final_limitations(spark, sf):
    notes, scored = technical_notes(spark, sf)
    return crawl.final_limitations(notes, scored, C.answer_states(spark, sf)).select("site_key", F.array_join("limitations", " ").alias("limitations"))


def label_reasons(spark, sf):
    """Labelled answers with a reason, so that causes can be counted."""
    rows = labelled(spark, sf)
    reason = F.when(F.col("verdict") == "not-found", "The agent never reached /x, the page with the answer.").otherwise("The agent read /x but answered incorrectly: no.")
    return rows.withColumn("reason", reason)


def final_stage(spark, sf):
    docs = C.table(spark, sf, "documents").groupBy(F.col("source").alias("site_key")).agg(F.count("*").alias("n"))
    technical = docs.select(
        "site_key", F.lit(26).alias("check_ord"), F.lit("update-info").alias("id"), F.lit("freshness").alias("group"), F.lit("maintenance").alias("category"),
        F.lit("Dates").alias("title"), F.when(F.col("n") % 2 == 0, "warn").otherwise("fail").alias("status"), F.lit("native").alias("source"), F.lit(2.0).alias("max"),
        F.when(F.col("n") % 2 == 0, 1.0).otherwise(0.0).alias("earned"), F.lit("m").alias("message"), F.lit("Date pages.").alias("fix"), F.lit(None).cast("array<string>").alias("evidence"),
    )
    coverage = docs.select("site_key", F.lit(15).alias("pages_tested"), F.lit(0).alias("rate_limited"))
    return finalize_report(technical, label_rollup(spark, sf), label_reasons(spark, sf), coverage)


_LAB = """
e AS (SELECT source AS site_key, CASE WHEN toxic = 1 THEN 'not-found' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict,
  doc_id % 3 <> 0 AS retrieved, CASE WHEN toxic = 0 THEN doc_id % 2 = 0 END AS supported FROM documents JOIN labels USING (doc_id)),
c0 AS (SELECT site_key, count(*) AS total, sum((verdict = 'correct')::INT) AS correct, sum(retrieved::INT) AS retrieved, sum((verdict <> 'not-found')::INT) AS answered,
  sum(coalesce(supported, FALSE)::INT) AS supported FROM e GROUP BY 1),
c AS (SELECT * FROM c0 WHERE total >= 5),
n AS (SELECT source AS site_key, count(*) AS n FROM documents GROUP BY 1),
pts AS (SELECT n.site_key, CASE WHEN n % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS dates, floor(7.0::DOUBLE * (retrieved::DOUBLE / total) * 10 + 0.5::DOUBLE) / 10 AS a,
  floor(14.0::DOUBLE * (correct::DOUBLE / total) * 10 + 0.5::DOUBLE) / 10 AS b, CASE WHEN answered > 0 THEN floor(7.0::DOUBLE * (supported::DOUBLE / answered) * 10 + 0.5::DOUBLE) / 10 END AS d,
  answered, total, correct FROM n LEFT JOIN c USING (site_key)),
fin AS (SELECT *, floor((dates + coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0)) * 10 + 0.5::DOUBLE) / 10 AS earned,
  2.0::DOUBLE + CASE WHEN total IS NULL THEN 0 ELSE 21 END + CASE WHEN d IS NULL THEN 0 ELSE 7 END AS possible FROM pts)
"""


@query("finalize_report", f"WITH {_LAB} SELECT site_key, earned, possible, CAST(floor(earned / possible * 100 + 0.5::DOUBLE) AS INT) AS score FROM fin")
def _finalize(spark, sf):
    return final_stage(spark, sf)[1].select("site_key", "earned", "possible", "score")


@query(
    "answer_fix",
    f"""WITH {_LAB}, m AS (SELECT site_key, sum((verdict = 'not-found')::INT) AS reach, sum((verdict = 'incorrect')::INT) AS wrong FROM e GROUP BY 1),
    lead AS (SELECT fin.site_key, 'answerability' AS check_id, floor((7 - a + 14 - b + CASE WHEN d IS NULL THEN 0 ELSE 7 - d END) * 10 + 0.5::DOUBLE) / 10 AS points, -1 AS o
      FROM fin JOIN m USING (site_key) WHERE total IS NOT NULL AND correct::DOUBLE / total < 0.8 AND reach + wrong >= 2),
    plain AS (SELECT site_key, 'update-info' AS check_id, 2 - dates AS points, CASE WHEN dates = 0 THEN 0 ELSE 1 END AS o, 26 AS co FROM fin
      UNION ALL SELECT site_key, 'evidence-retrieved', floor((7 - a) * 10 + 0.5::DOUBLE) / 10, CASE WHEN a / 7 >= 0.5 THEN 1 ELSE 0 END, 31 FROM fin WHERE a < 7
      UNION ALL SELECT site_key, 'answers-correct', floor((14 - b) * 10 + 0.5::DOUBLE) / 10, CASE WHEN b / 14 >= 0.5 THEN 1 ELSE 0 END, 32 FROM fin WHERE b < 14
      UNION ALL SELECT site_key, 'answers-supported', floor((7 - d) * 10 + 0.5::DOUBLE) / 10, CASE WHEN d / 7 >= 0.5 THEN 1 ELSE 0 END, 33 FROM fin WHERE d < 7),
    top AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY points DESC, o, co) AS rn FROM plain QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY points DESC, o, co) <= 3),
    merged AS (SELECT site_key, check_id, points, 0 AS rn FROM lead
      UNION ALL SELECT t.site_key, t.check_id, t.points, t.rn FROM top t LEFT JOIN lead l USING (site_key) WHERE l.site_key IS NULL OR t.check_id = 'update-info')
    SELECT site_key, check_id, points, row_number() OVER (PARTITION BY site_key ORDER BY points DESC, rn) AS fix_ord FROM merged
    QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY points DESC, rn) <= 3""",
)
def _answer_fix(spark, sf):
    return final_stage(spark, sf)[2].select("site_key", "check_id", "points", "fix_ord")


def prompt_inputs(spark, sf):
    k = F.col("c_custkey")
    sites = C.table(spark, sf, "customer").select(
        k.cast("string").alias("site_key"), C.text("https://docs", k, ".example.com").alias("scope_root"), F.col("c_name").alias("name"),
        C.text("https://reports.example.com/", k).alias("report_url"), (k % 9 + 1).alias("pages_tested"), C.text("https://docs", k, ".example.com/a").alias("first_page"),
        F.lit("2026-09-30").alias("started_on"), F.when(k % 5 == 0, "pending").otherwise("complete").alias("answer_state"),
    )
    entries = spark.createDataFrame([], "site_key string, question_ord int, question string, source_url string, verdict string, reason string")
    extras = C.table(spark, sf, "customer").select(
        k.cast("string").alias("site_key"), F.lit("mcp-server").alias("id"), F.lit("MCP server is discoverable").alias("title"),
        F.when(k % 4 == 0, "missing").otherwise("found").alias("status"), F.lit("None found.").alias("message"), F.lit("Offer one.").alias("fix"), F.lit(None).cast("array<string>").alias("evidence"),
    )
    return sites, entries, extras


@query("fix_prompt")
def _fix_prompt(spark, sf):
    sites, entries, extras = prompt_inputs(spark, sf)
    checks = C.check_results(spark, sf)
    return R.fix_prompt(sites, checks, extras, entries, X.top_fixes(checks), scores(spark, sf))


@query(
    "report_sink",
    f"""{_SCORE_REPORT}, {_FIX}, n AS (SELECT site_key, count(*) AS n_checks FROM checks GROUP BY 1), m AS (SELECT site_key, count(*) AS n_fixes FROM top GROUP BY 1)
    SELECT site_key, score, n_checks, coalesce(n_fixes, 0) AS n_fixes, '2026-09.6' AS methodology_version FROM rep JOIN n USING (site_key) LEFT JOIN m USING (site_key)""",
)
def _report_sink(spark, sf):
    sites, _, extras = prompt_inputs(spark, sf)
    checks = C.check_results(spark, sf)
    scored = scores(spark, sf)
    report = R.nested_report(scored.select("site_key"), checks, extras, X.top_fixes(checks), scored)
    store = ReportStore.like(report, f"{shared_folder(spark)}/docgauge-{spark.sparkContext.applicationId}/reports-{uuid.uuid4().hex}")
    for _ in range(2):  # the same run again replaces itself
        store.write(report, K.METHODOLOGY_VERSION, 1)
    return store.read(K.METHODOLOGY_VERSION).select(
        "site_key", "score", F.size("checks").alias("n_checks"), F.coalesce(F.size("top_fixes"), F.lit(0)).alias("n_fixes"), "methodology_version"
    )


def question_entries(spark, sf):
    """Six graded questions on each document, for the site of the customer that follows its number."""
    d, q = F.col("doc_id"), F.col("question_ord")
    rows = C.table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("question_ord"))
    h = (d * 7 + q * 3 + F.col("n")) % 10
    verdict = F.when(h < 2, "not-found").when(h < 5, "incorrect").otherwise("correct")
    reason = F.when(h < 2, C.text("The agent never reached /page-", d, ", the page with the answer.")).when(
        h < 5, C.text("The agent read /page-", d, " but answered incorrectly: no.")
    ).otherwise(C.text("Answered correctly from /page-", d, "."))
    return rows.select(
        (d + 1).cast("string").alias("site_key"), q, C.text("What does part ", q, " of the ", F.col("n"), " characters say?").alias("question"),
        C.text("https://docs.example.com/page-", d).alias("source_url"), F.lit("It says so.").alias("answer"), verdict.alias("verdict"), reason.alias("reason"),
        F.lit(None).cast("string").alias("cause"), (h != 1).alias("retrieved"), F.when(h >= 2, h % 2 == 0).alias("supported"),
        F.array(C.text("https://docs.example.com/page-", d)).alias("pages_visited"), F.array().cast("array<string>").alias("cited_urls"),
    )


def findings(spark, sf):
    sites, _, extras = prompt_inputs(spark, sf)
    notes, _ = technical_notes(spark, sf)
    checks = stored(C.check_results(spark, sf), scope())
    return Findings(sites.drop("pages_tested", "answer_state"), checks, extras, C.site_coverage(spark, sf), stored(notes, scope()), C.site_caps(spark, sf))


_OF = "https://docs.example.com/page-"
_ENTRIES = f"""
h AS (SELECT doc_id AS d, q, (doc_id * 7 + q * 3 + length(text)) % 10 AS h, length(text) AS n FROM documents, (SELECT unnest(range(6)) AS q)),
entry AS (SELECT CAST(d + 1 AS VARCHAR) AS site_key, q, 'What does part ' || q || ' of the ' || n || ' characters say?' AS question, '{_OF}' || d AS source_url,
  CASE WHEN h < 2 THEN 'not-found' WHEN h < 5 THEN 'incorrect' ELSE 'correct' END AS verdict, h <> 1 AS retrieved, CASE WHEN h >= 2 THEN h % 2 = 0 END AS supported,
  CASE WHEN h < 2 THEN 'The agent never reached /page-' || d || ', the page with the answer.' WHEN h < 5 THEN 'The agent read /page-' || d || ' but answered incorrectly: no.' END AS reason FROM h),
roll AS (SELECT site_key, count(*) AS total, sum((verdict = 'correct')::INT) AS correct, sum(retrieved::INT) AS retrieved, sum((verdict <> 'not-found')::INT) AS answered,
  sum(coalesce(supported, FALSE)::INT) AS supported, sum((verdict = 'not-found')::INT) AS reach, sum((verdict = 'incorrect')::INT) AS wrong FROM entry GROUP BY 1),
parts AS (SELECT site_key, 31 AS k, 7.0::DOUBLE AS max, retrieved AS good, total AS base FROM roll UNION ALL SELECT site_key, 32, 14.0::DOUBLE, correct, total FROM roll
  UNION ALL SELECT site_key, 33, 7.0::DOUBLE, supported, answered FROM roll),
checks AS (SELECT * FROM checks0 WHERE grp <> 'answerability' UNION ALL
  SELECT site_key, k, 'answerability', '', CASE WHEN base = 0 THEN 'skip' WHEN good = base THEN 'pass' WHEN good::DOUBLE / base >= 0.5 THEN 'warn' ELSE 'fail' END, max,
    CASE WHEN base > 0 THEN floor(max * (good::DOUBLE / base) * 10 + 0.5::DOUBLE) / 10 END, CASE WHEN good < base THEN 'x' END
  FROM parts WHERE site_key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)),
st AS (SELECT CAST(c_custkey AS VARCHAR) AS site_key, CASE WHEN roll.site_key IS NULL THEN 'unavailable' ELSE 'complete' END AS state
  FROM customer LEFT JOIN roll ON roll.site_key = CAST(c_custkey AS VARCHAR)),
"""
# The notes of the technical stage count its own unverified checks; only the provisional line is restated.
_FINAL_NOTES = _NOTES.replace("unverified > 0", "u0.n > 0").replace("FROM rep)", "FROM rep JOIN (SELECT site_key, sum((status = 'unverified')::INT) AS n FROM checks0 GROUP BY 1) u0 USING (site_key))")
_FINAL = (
    f"WITH {CHECKS}, {_CAPPED}, {_GROUPS}, {_REPORT}, {_FIX}, {_FINAL_NOTES}"
    .replace("checks AS (", "checks0 AS (", 1)
    .replace("totals AS (", _ENTRIES.lstrip() + "totals AS (", 1)
    .replace(_GROUPS[_GROUPS.index("st AS ("):_GROUPS.index("grid AS (")], "", 1)
)


@query(
    "final_report",
    _FINAL + """,
    lost AS (SELECT site_key, floor(sum(max - earned) * 10 + 0.5::DOUBLE) / 10 AS points FROM checks WHERE grp = 'answerability' AND earned IS NOT NULL GROUP BY 1),
    lead AS (SELECT r.site_key, 'Agents could not answer ' || (reach + wrong) || ' of ' || total || ' questions' AS title, points, 0 AS o FROM roll r JOIN lost USING (site_key)
      WHERE correct::DOUBLE / total < 0.8 AND reach + wrong >= 2),
    merged AS (SELECT site_key, title, points, o FROM lead UNION ALL
      SELECT t.site_key, CASE t.k WHEN 31 THEN 'Agents reached the pages they needed' WHEN 32 THEN 'Agents answered correctly' WHEN 33 THEN 'Answers were supported' ELSE 'Check ' || t.k END, t.points, t.fix_ord
      FROM top t LEFT JOIN lead l USING (site_key) WHERE l.site_key IS NULL OR t.grp <> 'answerability'),
    fixed AS (SELECT site_key, title, points, row_number() OVER (PARTITION BY site_key ORDER BY points DESC, o) AS fix_ord FROM merged QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY points DESC, o) <= 3),
    f AS (SELECT site_key, string_agg(CASE WHEN title LIKE 'Agents could%' OR title LIKE 'Check %' THEN title ELSE 'answer check' END || '=' || points, '; ' ORDER BY fix_ord) AS fixes FROM fixed GROUP BY 1),
    n AS (SELECT site_key, count(*) AS n_checks FROM checks GROUP BY 1),
    miss AS (SELECT site_key, count(*) AS n, string_agg(CASE WHEN rn <= 8 THEN '- "' || question || '": ' || reason || ' (source: ' || source_url || ')' END, chr(10) ORDER BY q) AS lines
      FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY q) AS rn FROM entry WHERE verdict <> 'correct') GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS site_key, rep.score, rep.earned, n_checks, fixes, CASE WHEN lim.site_key IS NOT NULL THEN array_to_string(list_concat(lim.notes, CASE WHEN st.state = 'unavailable'
        THEN ['Too few questions could be tested to give a fair score.'] ELSE [] END), ' ') END AS notes,
      CASE WHEN miss.n IS NULL THEN NULL ELSE 'Questions an agent could not answer (' || miss.n || ')' END AS missed_heading, miss.lines AS missed_lines, roll.total AS n_transcript
    FROM customer JOIN rep ON rep.site_key = CAST(c_custkey AS VARCHAR) JOIN st USING (site_key) LEFT JOIN lim USING (site_key) LEFT JOIN n USING (site_key) LEFT JOIN f USING (site_key)
    LEFT JOIN miss USING (site_key) LEFT JOIN roll USING (site_key)""",
)
def _final_report(spark, sf):
    """The whole way: findings of the technical stage and transcripts, the final report of every site, written, read back and digested."""
    found = findings(spark, sf)
    entries = stored(question_entries(spark, sf), scope())
    report = final_report(found, A.answerability_rollup(found.sites, entries), entries, scope())
    store = ReportStore.like(report, f"{shared_folder(spark)}/docgauge-{spark.sparkContext.applicationId}/final-{uuid.uuid4().hex}")
    store.write(report, K.METHODOLOGY_VERSION, 1)
    back = store.read(K.METHODOLOGY_VERSION)
    title = lambda f: F.when(f["title"].rlike("^(Agents could|Check )"), f["title"]).otherwise("answer check")
    fixes = F.transform("top_fixes", lambda f: F.concat(title(f), F.lit("="), f["points"].cast("string")))
    heading = F.nullif(F.regexp_extract("fix_prompt", r"## (Questions an agent could not answer \(\d+\))", 1), F.lit(""))
    lines = F.array_join(F.filter(F.split("fix_prompt", "\n"), lambda x: F.startswith(x, F.lit('- "'))), "\n")
    return back.filter(F.col("earned").isNotNull()).select(
        "site_key", "score", "earned", F.size("checks").alias("n_checks"), F.array_join(fixes, "; ").alias("fixes"), F.array_join("limitations", " ").alias("notes"),
        heading.alias("missed_heading"), F.when(heading.isNotNull(), lines).alias("missed_lines"), F.size("transcript").alias("n_transcript"),
    )
