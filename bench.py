"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each time covers building, planning and running one query in full (rows are produced and dropped). Kept tables are
released between queries, so none profits from another.
"""

from __future__ import annotations

import json
import os
import time

from docgauge.session import build_session, release_kept
from workload import load

HEADLINES = (
    "score_report", "overall_score", "group_score", "provisional_reasons", "top_fixes", "fix_order", "leaderboard",
    "afdocs_checks", "afdocs_cap", "cost_per_run", "usage_cost", "page_key", "url_identity", "content_text", "page_facts",
    "content_references", "collect_references", "endpoint_mentions", "platform_detect", "pick_evenly", "robots_access",
    "grounded_quotes", "evidence_reached", "diagnose", "transcript_entry", "select_questions", "refusal_backoff",
    "crawl_plan", "fetch_stats", "agent_text", "choose_scope_sitemap", "sitemap_live", "links_and_anchors", "report_sink",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Call-site capture for error messages costs more than building the plan itself.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["counted_checks"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINES:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        release_kept()
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
