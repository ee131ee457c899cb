"""Answerability: which questions are grounded, what the agent reached, why it missed, and the roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docgauge import constants as K
from docgauge.functions import text as T, urls as U
from docgauge.functions.numbers import grouped_text, rounded, status_for_credit
from docgauge.operators.common import first_n, first_per, native_check, numbered, ordered_texts
from docgauge.operators.identity import registrable

QUESTION = ["site_key", "question_ord"]
# Rows that can still matter to the greedy choice; see select_questions.
_PER_PAGE = K.MAX_QUESTIONS + K.MAX_QUESTIONS_PER_PAGE
_PER_QUESTION = K.MAX_QUESTIONS // K.MAX_QUESTIONS_PER_PAGE + 1
_PER_SITE = K.MAX_QUESTIONS * (1 + _PER_QUESTION) + (K.MAX_QUESTIONS // K.MAX_QUESTIONS_PER_PAGE) * _PER_PAGE
# Quotes of a site that are all tested on each of its pages.
_FEW_QUOTES = 64


def grounded_quotes(questions: DataFrame, source_pages: DataFrame) -> DataFrame:
    """Adds ``grounded``: the evidence quote is on the page the question claims; unknown pages ground nothing."""
    pages = source_pages.select("site_key", F.col("url").alias("source_url"), "text")
    joined = questions.join(pages, ["site_key", "source_url"], "left")
    return joined.withColumn("grounded", T.contains_quote(F.col("text"), F.col("evidence_quote"))).drop("text")


def quote_pages(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """``site_key, question_ord, url``: every page of the site that holds a question's quote, as ``contains_quote`` decides.

    ``questions``: ``site_key, question_ord, evidence_quote``; ``pages``: ``site_key, url, text``. Empty and null quotes are nowhere.

    The pages of a site with few quotes are tested with all of them: they move once. For the other sites this is a set-containment join. A page
    may lack at most 15 % of a quote's words, or, where it holds the quote as one string that begins or ends
    inside words, the first and the last. So of a quote's words, rarest on the site's pages first, one of the shortest run that outweighs what may be
    lacking is on every page that counts: quotes meet pages at these words only. Quotes of one or two words may lie inside longer words;
    they meet the site's words that contain their first one, found by equal cuts of the lengths that occur. What meets is tested on the texts.
    """
    site, question = "site_key", ["site_key", "question_ord"]
    asked = questions.select(*question, T.normalize_for_match(F.col("evidence_quote")).alias("needle")).filter(F.col("needle") != "").distinct()
    held = pages.select(site, "url", T.normalize_for_match(F.col("text")).alias("hay"))

    first = first_n(asked, [site], ["question_ord", "needle"], _FEW_QUOTES + 1)
    first = first.groupBy(site).agg(F.collect_list(F.struct("question_ord", "needle")).alias("quotes"))
    few, many = first.filter(F.size("quotes") <= _FEW_QUOTES), first.filter(F.size("quotes") > _FEW_QUOTES).select(site)
    every = F.array_distinct(F.flatten(F.transform("quotes", lambda q: F.split(q["needle"], " "))))
    here = held.join(few.withColumn("words", every), site).withColumn("known", F.array_intersect("words", F.split("hay", " ")))
    fits = F.filter("quotes", lambda q: T.holds(F.col("hay"), q["needle"], F.col("known")))
    near = here.select(site, "url", F.explode_outer(fits).alias("q")).filter("q IS NOT NULL").select(site, "q.question_ord", "url")

    far = _met_pages(asked.join(many, site, "left_semi"), held.join(many, site, "left_semi"))
    return near.unionByName(far).distinct()


def _met_pages(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``quote_pages`` of normalised quotes (site_key, question_ord, needle) and pages (site_key, url, hay), for sites with any number of quotes."""
    site = "site_key"
    # Rows of one question with different quotes stay apart by their quote.
    question = [site, "question_ord", "needle"]
    words = asked.select(*question, F.explode(F.split("needle", " ")).alias("word")).groupBy(*question, "word").agg(F.count("*").alias("times"))
    # Rows of two hashes in place of three texts. Words or pages of one hash make more candidates, never fewer, and texts decide.
    hashed = lambda word: F.xxhash64(site, word)
    page = F.xxhash64(site, "url").alias("page")
    # The outer form: a plain explode would test the page's words for emptiness first, and so take them twice. A page with several texts may have
    # a word several times, which only makes it seem less rare.
    on_page = held.select(page, F.explode_outer(F.transform(F.array_distinct(F.split("hay", " ")), hashed)).alias("at"))
    words = words.withColumn("at", hashed(F.col("word")))

    # Page words that no quote names are dropped before anything is counted. One page is asked for, though every word has one: Spark then moves
    # the texts once, with their addresses, for this and the other steps.
    known = on_page.join(words.select("at").distinct(), "at", "left_semi").groupBy("at").agg(F.count("*").alias("found_on"), F.max("page").alias("one"))
    known = known.filter("one IS NOT NULL").drop("one")
    n = F.size(F.split("needle", " "))
    # A little over the exact share: one key too many costs a test, one too few would lose a page.
    lacking = F.greatest(F.lit(2), F.floor(n * F.lit(1 - K.QUOTE_OVERLAP) + F.lit(0.001)))
    ranked = words.join(known, "at", "left").withColumn("found_on", F.coalesce("found_on", F.lit(0)))
    before = Window.partitionBy(*question).orderBy("found_on", "word").rowsBetween(Window.unboundedPreceding, -1)
    keyed = ranked.withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0)))
    keyed = keyed.filter((n > 2) & (F.col("before") <= lacking) & (F.col("found_on") > 0)).select(*question, "at")

    short = asked.filter(n <= 2).withColumn("piece", F.split_part("needle", F.lit(" "), F.lit(1)))
    sizes = short.groupBy(site).agg(F.sort_array(F.collect_set(F.length("piece"))).alias("sizes"))
    vocabulary = held.select(site, page, F.explode_outer(F.split("hay", " ")).alias("word")).groupBy(site, "word").agg(F.max("page").alias("one"))
    vocabulary = vocabulary.filter("word <> '' AND one IS NOT NULL").join(sizes, site)
    starts = lambda size: F.sequence(F.lit(1), F.length("word") - size + 1)
    fitting = F.filter("sizes", lambda size: size <= F.length("word"))
    pieces = F.flatten(F.transform(fitting, lambda size: F.transform(starts(size), lambda at: F.substring(F.col("word"), at, size))))
    inside = vocabulary.select(site, "word", F.explode(F.array_distinct(pieces)).alias("piece"))
    short = short.join(inside, [site, "piece"]).select(*question, hashed(F.col("word")).alias("at"))

    met = keyed.unionByName(short).join(on_page, "at").select(*question, "page").distinct()
    tested = met.join(held.withColumn("page", page), [site, "page"]).filter(T.holds(F.col("hay"), F.col("needle")))
    return tested.select(site, "question_ord", "url")


def select_questions(questions: DataFrame, source_pages: DataFrame) -> DataFrame:
    """Greedy choice in candidate order: grounded, with facts, distinct, two per page, eight per site.

    A question dropped by the page limit does not block the same question on a later page, so this is a fold. It
    runs over a bounded list: a page can lose at most eight candidates to questions already kept, a question can
    meet at most four full pages, and the fold stops at eight, so later rows cannot change the outcome.
    """
    valid = grounded_quotes(questions, source_pages).filter(
        F.col("grounded") & (F.size("answer_facts") > 0)
    )
    keyed = valid.withColumn("__q", F.lower(F.trim("question")))
    keyed = first_per(keyed, ["site_key", "source_url", "__q"], ["candidate_ord"])
    keyed = first_n(keyed, ["site_key", "source_url"], ["candidate_ord"], _PER_PAGE)
    keyed = first_n(keyed, ["site_key", "__q"], ["candidate_ord"], _PER_QUESTION)
    keyed = first_n(keyed, ["site_key"], ["candidate_ord"], _PER_SITE)
    row = F.struct("candidate_ord", "source_url", "__q", "question", "answer_facts", "evidence_quote")
    per_site = keyed.groupBy("site_key").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    ordinal = questions.schema["candidate_ord"].dataType.simpleString()
    shape = (
        f"array<struct<candidate_ord:{ordinal},source_url:string,__q:string,question:string,answer_facts:array<string>,"
        "evidence_quote:string>>"
    )
    kept = F.aggregate(
        "rows",
        F.array().cast(shape),
        lambda acc, r: F.when(
            (F.size(acc) < K.MAX_QUESTIONS)
            & ~F.exists(acc, lambda k: k["__q"] == r["__q"])
            & (F.size(F.filter(acc, lambda k: k["source_url"] == r["source_url"])) < K.MAX_QUESTIONS_PER_PAGE),
            F.concat(acc, F.array(r)),
        ).otherwise(acc),
    )
    return per_site.select("site_key", F.posexplode(kept).alias("question_ord", "q")).select(
        "site_key", "question_ord", F.col("q.candidate_ord").alias("candidate_ord"),
        F.left(F.trim("q.question"), F.lit(300)).alias("question"),
        F.col("q.source_url").alias("source_url"),
        F.transform(F.slice("q.answer_facts", 1, 4), lambda f: F.left(f, F.lit(300))).alias("answer_facts"),
        F.left("q.evidence_quote", F.lit(400)).alias("evidence_quote"),
    )


def _fetches_with_question(questions: DataFrame, fetches: DataFrame) -> DataFrame:
    wanted = questions.select(*QUESTION, "source_url", "evidence_quote")
    joined = wanted.join(fetches, QUESTION)
    return joined.withColumn("same_page", U.same_page(F.col("url"), F.col("source_url")))


def evidence_reached(questions: DataFrame, fetches: DataFrame) -> DataFrame:
    """Adds ``retrieved``: the agent read the answer's page, or another page that carries the evidence."""
    joined = _fetches_with_question(questions, fetches)
    on_page = F.col("same_page") & F.coalesce(F.col("status") < 400, F.lit(False))
    # The cheap test decides first; the text comparison only runs for other pages.
    hit = F.when(on_page, True).otherwise(
        (F.length("agent_text") > 0) & T.contains_quote(F.col("agent_text"), F.col("evidence_quote"))
    )
    reached = joined.groupBy(*QUESTION).agg(F.bool_or(hit).alias("retrieved"))
    return questions.join(reached, QUESTION, "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(False)))


def out_of_site_fetch(fetches: DataFrame, sites: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds ``refused`` to agent fetches whose URL is outside the site's registrable domain."""
    hosted = U.with_url(fetches, "url", "f_")
    hosted = registrable(hosted, "f_host", suffixes, "f_")
    own = registrable(sites.select("site_key", "domain"), "domain", suffixes, "s_").select("site_key", "s_base_domain")
    joined = hosted.join(own, "site_key", "left")
    refused = F.coalesce(F.col("f_base_domain") != F.col("s_base_domain"), F.lit(True))
    return joined.withColumn("refused", refused).select(*fetches.columns, "refused")


def cited_passages(answers: DataFrame, fetches: DataFrame) -> DataFrame:
    """What the agent read at the URLs it cited: ``passage_ord, url, passage``, three per question, one per page read."""
    cited = numbered(answers, QUESTION, T.cited_urls(F.col("answer")), "cite_ord", "cited")
    cited = cited.withColumn("page_key", U.page_key(F.col("cited")))
    read = fetches.filter(F.length("agent_text") > 0).select(
        *QUESTION, "fetch_ord", F.col("url").alias("read_url"), F.left("agent_text", F.lit(K.PASSAGE_CHARS)).alias("passage"),
        U.page_key(F.col("url")).alias("page_key"),
    )
    read = first_per(read, [*QUESTION, "page_key"], ["fetch_ord"])
    found = first_per(cited.join(read, [*QUESTION, "page_key"]), [*QUESTION, "read_url"], ["cite_ord"])
    ranked = first_n(found, QUESTION, ["cite_ord"], K.MAX_PASSAGES, "passage_ord")
    return ranked.select(*QUESTION, "passage_ord", F.col("read_url").alias("url"), "passage")


def judgements(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Graded answers only: ``verdict, judge_reason, supported``.

    An empty or "not found" answer needs no judge; without a cited passage nothing supports an answer; operational
    errors and ungraded answers drop out.
    """
    has_passage = passages.select(*QUESTION).distinct().withColumn("has_passage", F.lit(True))
    joined = answers.filter(F.col("operational_error").isNull()).join(has_passage, QUESTION, "left")
    missing = F.coalesce(F.col("answer"), F.lit("")).rlike(r"(?i)^(not found\b|$)")
    verdict = F.when(missing, "not-found").otherwise(F.col("judge_verdict"))
    reason = F.when(missing, "The agent said it could not find the answer.").otherwise(
        F.left(F.trim("judge_reason"), F.lit(300))
    )
    supported = F.when(
        F.col("verdict") != "not-found",
        F.coalesce("has_passage", F.lit(False)) & F.coalesce("judge_supported", F.lit(False)),
    )
    return (
        joined.withColumn("verdict", verdict)
        .filter(F.col("verdict").isNotNull())
        .select(*QUESTION, "answer", "verdict", reason.alias("judge_reason"), supported.alias("supported"))
    )


def diagnose(
    questions: DataFrame, source_pages: DataFrame, fetches: DataFrame, judged: DataFrame
) -> DataFrame:
    """Adds ``cause`` and ``reason`` to judged questions, from what the agent actually fetched."""
    joined = _fetches_with_question(questions, fetches)
    facts = F.struct(
        "fetch_ord", "status", "truncated", "full_length", F.length("agent_text").alias("read_length"),
        T.contains_quote(F.col("agent_text"), F.col("evidence_quote")).alias("has_quote"),
    )
    # Only the first fetch of the answer's page decides; its text is compared there and not carried on.
    first = first_per(joined.filter("same_page"), QUESTION, ["fetch_ord"]).select(*QUESTION, facts.alias("read"))
    trail = first_n(joined.select(*QUESTION, "fetch_ord", "url"), QUESTION, ["fetch_ord"], 4)
    trail = trail.groupBy(*QUESTION).agg(
        ordered_texts(F.col("fetch_ord"), U.short_path(F.col("url")), F.lit(True), 4).alias("visited")
    )
    scripts = source_pages.select("site_key", F.col("url").alias("source_url"), "needs_javascript")
    rows = (
        judged.join(questions.select(*QUESTION, "question", "source_url", "evidence_quote"), QUESTION)
        .join(first, QUESTION, "left")
        .join(trail, QUESTION, "left")
        .join(scripts, ["site_key", "source_url"], "left")
        .withColumn("source_path", U.short_path(F.col("source_url")))
    )
    read, status = F.col("read"), F.col("read.status")
    cause = (
        F.when(F.col("verdict") == "correct", None)
        .when(read.isNull(), "not-reached")
        .when(status.isNull() | (status >= 400), "error-status")
        .when(~F.col("read.has_quote") & F.col("read.truncated"), "truncated")
        .when(~F.col("read.has_quote") & F.coalesce("needs_javascript", F.lit(False)), "javascript")
        .when(~F.col("read.has_quote"), "not-in-text")
        .otherwise("misread")
    )
    return rows.withColumn("cause", cause).withColumn("reason", _reason()).drop(
        "read", "visited", "needs_javascript", "source_path"
    )


def _reason() -> Column:
    path, status, cause = F.col("source_path"), F.col("read.status"), F.col("cause")
    visited = F.when(
        F.size("visited") > 0, F.concat(F.lit(" It read "), F.array_join("visited", ", "), F.lit("."))
    ).otherwise(" It could not find a way in.")

    def said(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return (
        F.when(cause.isNull(), said("Answered correctly from ", path, "."))
        .when(cause == "not-reached", said("The agent never reached ", path, ", the page with the answer.", visited))
        .when(
            cause == "error-status",
            said(
                path,
                F.when(F.coalesce(status, F.lit(0)) != 0, said(" returned ", status.cast("string"))).otherwise(
                    " could not be fetched"
                ),
                " when the agent requested it.",
            ),
        )
        .when(
            cause == "truncated",
            said(
                "The answer is on ", path, ", but the page is ", grouped_text(F.col("read.full_length")),
                " characters long and the agent only reads the first ", grouped_text(F.col("read.read_length")),
                ", so the answer was cut off.",
            ),
        )
        .when(
            cause == "javascript",
            said("The answer on ", path, " only appears after JavaScript runs, and the agent reads pages without JavaScript."),
        )
        .when(
            cause == "not-in-text",
            said(
                "The agent read ", path, ", but the answer was not in the text it received, for example inside a tab "
                "or widget that is not in the HTML.",
            ),
        )
        .when(
            F.col("verdict") == "not-found",
            said(
                "The agent read ", path, ", where the answer is, but did not recognise it. The answer may be buried or "
                "worded differently from the question.",
            ),
        )
        .otherwise(said("The agent read ", path, " but answered incorrectly: ", F.col("judge_reason")))
    )


def transcript(
    questions: DataFrame, source_pages: DataFrame, fetches: DataFrame, answers: DataFrame
) -> DataFrame:
    """One row per graded question with everything a report shows about it."""
    judged = judgements(answers, cited_passages(answers, fetches))
    explained = diagnose(questions, source_pages, fetches, judged)
    reached = evidence_reached(questions, fetches).select(*QUESTION, "retrieved")
    pages = first_n(fetches.select(*QUESTION, "fetch_ord", "url"), QUESTION, ["fetch_ord"], 6)
    pages = pages.groupBy(*QUESTION).agg(
        ordered_texts(F.col("fetch_ord"), F.col("url"), F.lit(True), 6).alias("pages_visited")
    )
    rows = explained.join(reached, QUESTION, "left").join(pages, QUESTION, "left")
    return rows.select(
        *QUESTION, "question", "source_url", F.left("answer", F.lit(1200)).alias("answer"), "verdict", "reason", "cause",
        "retrieved", "supported", F.coalesce("pages_visited", F.array().cast("array<string>")).alias("pages_visited"),
        F.slice(T.cited_urls(F.col("answer")), 1, 6).alias("cited_urls"),
    )


def answerability_rollup(
    sites: DataFrame, entries: DataFrame, pages: DataFrame | None = None, questions: DataFrame | None = None
) -> DataFrame:
    """Counts per site and whether they are enough to score; five graded questions are needed.

    With ``pages`` (source pages) and ``questions`` the earlier reasons for being unavailable are told apart.
    """
    counts = entries.groupBy("site_key").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("verdict") == "correct").alias("correct"),
        F.count_if("retrieved").alias("retrieved"),
        F.count_if(F.col("verdict") != "not-found").alias("answered"),
        F.count_if(F.coalesce("supported", F.lit(False))).alias("supported"),
    )
    rows = sites.select("site_key").join(counts, "site_key", "left")
    few_pages = few_questions = F.lit(False)
    if pages is not None:
        readable = pages.groupBy("site_key").agg(F.count("*").alias("source_pages"))
        rows = rows.join(readable, "site_key", "left")
        few_pages = F.coalesce("source_pages", F.lit(0)) < 2
    if questions is not None:
        asked = questions.groupBy("site_key").agg(F.count("*").alias("asked"))
        rows = rows.join(asked, "site_key", "left")
        few_questions = F.coalesce("asked", F.lit(0)) < K.MIN_QUESTIONS
    total = F.coalesce("total", F.lit(0))
    reason = (
        F.when(few_pages, "Too few readable pages to write questions from.")
        .when(few_questions, "Not enough answerable questions could be written from the sampled pages.")
        .when(total < K.MIN_QUESTIONS, "Too few questions could be tested to give a fair score.")
    )
    complete = reason.isNull()
    return rows.select(
        "site_key",
        F.when(complete, "complete").otherwise("unavailable").alias("state"),
        reason.alias("reason"),
        *[
            F.when(complete, F.coalesce(name, F.lit(0))).otherwise(0).alias(name)
            for name in ("total", "correct", "retrieved", "answered", "supported")
        ],
    )


def answerability_checks(rollup: DataFrame) -> DataFrame:
    """The three answer checks of completed runs."""
    rows = rollup.filter((F.col("state") == "complete") & (F.col("total") > 0))
    total = F.col("total")

    def check(check_id: str, ordinal: int, good: str, base: Column, said: str, fix: str) -> DataFrame:
        credit = F.col(good) / F.when(base > 0, base)
        status = F.when(base == 0, "skip").otherwise(status_for_credit(credit))
        message = F.when(base == 0, "The agent gave no answers to check for support.").otherwise(
            F.concat_ws(" ", F.format_string(said, F.col(good), base))
        )
        return native_check(rows, check_id, ordinal, status, credit, message, F.when(credit < 1, fix))

    return (
        check(
            "evidence-retrieved", 31, "retrieved", total,
            "The agent reached the page holding the answer for %d of %d questions.",
            "Make every page reachable from the docs entry page and llms.txt, with titles in the words people use.",
        )
        .unionByName(
            check(
                "answers-correct", 32, "correct", total,
                "%d of %d answers agreed with the sentence they came from.",
                "State each answer plainly near the top of the section that covers it, in the words people ask with.",
            )
        )
        .unionByName(
            check(
                "answers-supported", 33, "supported", F.col("answered"),
                "%d of %d answers were backed by the pages the agent cited.",
                "Keep each fact on the page that makes the claim, so an answer can cite the passage it came from.",
            )
        )
    )


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    rows = [(m, float(i), float(o)) for m, (i, o) in (prices or K.MODEL_PRICES).items()]
    return spark.createDataFrame(rows, "model string, input_price double, output_price double")


def usage_cost(usage: DataFrame, prices: DataFrame, fallback: tuple[float, float] = K.FALLBACK_PRICE) -> DataFrame:
    """Adds ``cost_usd`` to token counts; models missing from the table cost the conservative fallback.

    The price table is small configuration and its size is known to Spark, which broadcasts it by itself.
    """
    joined = usage.join(prices, "model", "left")
    cost = (
        F.col("input_tokens") * F.coalesce("input_price", F.lit(fallback[0]))
        + F.col("output_tokens") * F.coalesce("output_price", F.lit(fallback[1]))
    ) / F.lit(1_000_000)
    return joined.withColumn("cost_usd", cost).drop("input_price", "output_price")


def cost_per_run(usage: DataFrame, prices: DataFrame, fallback: tuple[float, float] = K.FALLBACK_PRICE) -> DataFrame:
    """Dollars per site to four places, and whether the run passed its token budget."""
    priced = usage_cost(usage, prices, fallback)
    return priced.groupBy("site_key").agg(
        # whole hundred-millionths of a dollar: their sum does not depend on the order of rows
        rounded(F.sum(F.round(F.col("cost_usd") * 100_000_000).cast("bigint")) / 100_000_000, 10_000).alias("cost_usd"),
        F.sum("input_tokens").alias("input_tokens"),
        (F.sum("input_tokens") > K.MAX_INPUT_TOKENS).alias("over_budget"),
    )


def miss_cause_fix(entries: DataFrame) -> DataFrame:
    """``site_key, misses, cause_ord, cause_count, fix``: the cause behind most missed answers, first on a tie."""
    missed = entries.filter(F.col("verdict") != "correct")
    counts = missed.groupBy("site_key").agg(
        F.count("*").alias("misses"),
        *[F.count_if(F.col("reason").rlike(p)).alias(f"c{i}") for i, (p, _) in enumerate(K.MISS_CAUSE_FIXES)],
    )
    candidates = F.array(
        *[
            F.struct(F.col(f"c{i}").alias("n"), F.lit(-i).alias("neg_ord"), F.lit(fix).alias("fix"))
            for i, (_, fix) in enumerate(K.MISS_CAUSE_FIXES)
        ]
    )
    return counts.select("site_key", "misses", F.array_max(candidates).alias("lead")).select(
        "site_key", "misses", (-F.col("lead.neg_ord")).alias("cause_ord"), F.col("lead.n").alias("cause_count"),
        F.when(F.col("lead.n") > 0, F.col("lead.fix")).alias("fix"),
    )
