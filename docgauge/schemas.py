"""Schemas of the captured tables. Every list carries an explicit ordinal: Spark rows have no order."""

RESPONSES = (
    "site_key string, fetch_ord bigint, url string, method string, accept string, status int, content_type string, "
    "headers map<string,string>, body string, final_url string, redirected boolean, truncated boolean, "
    "failure string, fetched_at timestamp"
)
PAGES = "site_key string, page_ord bigint, url string, html string, last_modified string"
SITES = "site_key string, scope_root string, domain string, profile string, locale string, version string"
SITEMAP_DOCS = "url string, body string"
ROBOTS_RESPONSES = "origin string, status int, body string"
CHECK_RESULTS = (
    "site_key string, check_ord bigint, id string, `group` string, category string, title string, status string, "
    "source string, max double, earned double, message string, fix string, evidence array<string>"
)
AGENT_DOCS_RESULTS = (
    "site_key string, id string, category string, status string, message string, resolution string, "
    "proportion double, display_mode string, earned double, max double, "
    "page_results array<struct<url:string,status:string>>"
)
DIAGNOSTICS = "site_key string, id string"
QUESTIONS = (
    "site_key string, candidate_ord bigint, question string, source_url string, answer_facts array<string>, "
    "evidence_quote string"
)
SOURCE_PAGES = "site_key string, url string, title string, text string, needs_javascript boolean"
AGENT_FETCHES = (
    "site_key string, question_ord bigint, fetch_ord bigint, url string, status int, agent_text string, "
    "truncated boolean, full_length bigint"
)
ANSWERS = (
    "site_key string, question_ord bigint, answer string, operational_error string, judge_verdict string, "
    "judge_reason string, judge_supported boolean"
)
MODEL_USAGE = "site_key string, model string, input_tokens bigint, output_tokens bigint"
