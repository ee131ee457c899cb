"""robots.txt as tables: file state, rule rows, and which agents may fetch a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docgauge import constants as K
from docgauge.operators.common import numbered


def robots_file_state(responses: DataFrame) -> DataFrame:
    """``origin, state, text`` from captured robots.txt answers (``origin, status, body``)."""
    status = F.col("status")
    state = (
        F.when(status.isNull() | (status >= 500) | (status == 429), "unreachable")
        .when(status >= 400, "missing")
        .otherwise("ok")
    )
    text = F.when(state == "ok", F.left("body", F.lit(K.MAX_ROBOTS_CHARS))).otherwise("")
    return responses.select("origin", state.alias("state"), text.alias("text"))


def robots_lines(files: DataFrame) -> DataFrame:
    """``origin, line_ord, field, value, group_id`` of every directive.

    A group opens at an agent line that does not follow another agent line; any other directive closes the list of
    agents. The lines of a file (at most 500 KiB) are numbered by a running sum, in time that follows their number.
    """
    lines = F.transform(
        F.split(F.col("text"), r"\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(line, r"\s*#.*$", ""))
    )
    fields = F.transform(
        F.filter(lines, lambda line: line.rlike("^[^:]+:")),
        lambda line: F.struct(
            F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))).alias("field"),
            F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"),
        ),
    )
    rows = files.filter(F.col("state") == "ok").select("origin", fields.alias("fields"))
    marked = F.transform(
        "fields",
        lambda f, i: F.struct(
            f["field"].alias("field"),
            f["value"].alias("value"),
            ((f["field"] == "user-agent") & ((i == 0) | (F.get(F.col("fields"), i - 1)["field"] != "user-agent"))).cast("int").alias("opens"),
        ),
    )
    lines = numbered(rows.select("origin", marked.alias("fields")), ["origin"], "fields", "line_ord", "f")
    so_far = Window.partitionBy("origin").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select(
        "origin", "line_ord", F.col("f.field").alias("field"), F.col("f.value").alias("value"),
        F.sum("f.opens").over(so_far).cast("int").alias("group_id"),
    )


def _token(agent: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(agent), "/.*$", ""))


def robots_rules(files: DataFrame) -> DataFrame:
    """``origin, group_id, agent, allow, pattern, ord``: each rule once per agent its group names."""
    lines = robots_lines(files)
    agents = lines.filter(F.col("field") == "user-agent").select(
        "origin", "group_id", _token(F.col("value")).alias("agent")
    ).distinct()
    rules = lines.filter(F.col("field").isin("allow", "disallow") & (F.col("group_id") > 0))
    rules = rules.select(
        "origin", "group_id", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"),
        F.col("line_ord").alias("ord"),
    )
    return agents.join(rules, ["origin", "group_id"], "left")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    return robots_lines(files).filter(F.col("field") == "sitemap").select(
        "origin", F.col("line_ord").alias("sitemap_ord"), F.col("value").alias("sitemap")
    )


def crawl_delays(files: DataFrame, agent: str = "*") -> DataFrame:
    """``origin, crawl_delay_ms`` for one agent, its own group first and ``*`` otherwise."""
    lines = robots_lines(files)
    agents = lines.filter(F.col("field") == "user-agent").select("origin", "group_id", _token(F.col("value")).alias("agent"))
    delays = lines.filter(F.col("field") == "crawl-delay").select(
        "origin", "group_id", (F.col("value").try_cast("double") * 1000).alias("ms")
    )
    named = agents.filter(F.col("agent").isin(agent.lower(), "*")).join(delays, ["origin", "group_id"])
    rank = F.when(F.col("agent") == agent.lower(), 0).otherwise(1)
    return named.groupBy("origin").agg(
        F.greatest(F.min_by("ms", F.struct(rank, "group_id")), F.lit(0.0)).alias("crawl_delay_ms")
    )


def rule_regex(pattern: Column) -> Column:
    """A robots path pattern as a regular expression: ``*`` is any run, a closing ``$`` anchors."""
    escaped = F.regexp_replace(pattern, r"([.\\+?()\[\]{}|^$])", r"\\$1")
    wild = F.replace(escaped, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.regexp_replace(wild, r"\\\$$", "\\$"))


def _head(pattern: Column) -> Column:
    """The part of a pattern before its first ``*`` or closing ``$``: every path it matches begins with it."""
    return F.regexp_replace(pattern, r"(?s)(\*.*|\$)$", "")


def robots_access(targets: DataFrame, files: DataFrame, rules: DataFrame, agents: list[str]) -> DataFrame:
    """Adds ``agent`` and ``allowed`` for each target URL and agent.

    ``targets``: ``origin, path`` plus keys. Longest matching rule wins, allow on a tie; null where the file is
    unreachable; everything is allowed without a file or without a matching rule, and ``/robots.txt`` itself always.

    A path meets only rules whose literal head it begins with: it is cut to the head lengths its origin's rules have, and the cuts join the
    heads by equality. Rules without ``*`` or ``$`` are then decided; only the others are tested as patterns. So a file of n rules and n
    paths never makes n * n rows, unless its rules begin with ``*``. The rule table is never broadcast by force or crossed.
    """
    keys = [c for c in targets.columns]
    wanted = targets.withColumn("agent", F.explode(F.array(*[F.lit(a) for a in agents])))
    wanted = wanted.withColumn("token", _token(F.col("agent")))
    wanted = wanted.join(files.select("origin", "state"), "origin", "left")
    named = rules.select("origin", F.col("agent").alias("token")).distinct().withColumn("own_group", F.lit(True))
    wanted = wanted.join(named, ["origin", "token"], "left")
    wanted = wanted.withColumn("token", F.when(F.col("own_group"), F.col("token")).otherwise("*")).drop("own_group")
    usable = rules.filter(F.col("pattern") != "").groupBy("origin", F.col("agent").alias("token"), "pattern").agg(F.max("allow").alias("allow"))
    usable = usable.withColumn("head", _head(F.col("pattern")))
    plain = F.col("head") == F.col("pattern")
    # Of equal plain rules one is left, so a cut meets one plain rule at most.
    cuts = usable.groupBy("origin", "token").agg(F.sort_array(F.collect_set(F.length("head"))).alias("cuts"))
    cut = wanted.join(cuts, ["origin", "token"], "left").withColumn(
        "cut", F.explode_outer(F.filter("cuts", lambda n: n <= F.length("path")))
    )
    cut = cut.withColumn("head", F.left("path", F.col("cut"))).drop("cuts", "cut")
    met = cut.join(usable, ["origin", "token", "head"], "left").withColumn(
        "hit", F.col("pattern").isNotNull() & F.when(plain, True).otherwise(F.regexp_like(F.col("path"), rule_regex(F.col("pattern"))))
    )
    strength = F.when(F.col("hit"), F.struct(F.length("pattern").alias("n"), F.col("allow").cast("int").alias("a")))
    decided = met.groupBy(*keys, "agent", "state").agg(F.max(strength).alias("winner"))
    allowed = F.when(F.col("path") == "/robots.txt", F.lit(True)).when(F.col("state") == "unreachable", F.lit(None).cast("boolean")).otherwise(
        F.coalesce(F.col("winner.a") == 1, F.lit(True))
    )
    return decided.select(*keys, "agent", F.coalesce("state", F.lit("missing")).alias("state"), allowed.alias("allowed"))
