"""Comparing the endpoints pages mention with the published API description."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docgauge import constants as K
from docgauge.functions.numbers import status_for_credit
from docgauge.operators.common import first_n, native_check, ordered_texts


def spec_match(mentions: DataFrame, operations: DataFrame, base_paths: DataFrame) -> DataFrame:
    """Adds ``spec_operation`` per distinct (site, mentioned operation): itself, or itself without a server base path.

    Candidates are exploded and joined on equality, so no prefix comparison between tables is needed.
    """
    distinct = mentions.select("site_key", "operation").distinct()
    method = F.regexp_extract("operation", r"^(\S+) ", 1)
    path = F.regexp_extract("operation", r"^\S+ (.*)$", 1)
    direct = distinct.select("site_key", "operation", F.lit(-1).alias("base_ord"), F.col("operation").alias("candidate"))
    based = distinct.join(base_paths, "site_key").filter(
        F.startswith(path, F.concat(F.col("base_path"), F.lit("/")))
    )
    based = based.select(
        "site_key", "operation", "base_ord",
        F.concat_ws(" ", method, F.substr(path, F.length("base_path") + 1)).alias("candidate"),
    )
    known = operations.select("site_key", F.col("operation").alias("candidate"), "deprecated")
    hits = direct.unionByName(based).join(known, ["site_key", "candidate"])
    best = hits.groupBy("site_key", "operation").agg(
        F.min(F.struct("base_ord", "candidate", "deprecated")).alias("hit")
    )
    return distinct.join(best, ["site_key", "operation"], "left").select(
        "site_key", "operation", F.col("hit.candidate").alias("spec_operation"),
        F.coalesce("hit.deprecated", F.lit(False)).alias("deprecated"),
    )


def api_spec_match(sites: DataFrame, spec: DataFrame, mentions: DataFrame, matched: DataFrame) -> DataFrame:
    """``matched`` from ``spec_match``."""
    totals = matched.groupBy("site_key").agg(
        F.count("*").alias("mentioned"), F.count_if(F.col("spec_operation").isNull()).alias("missing")
    )
    seen = mentions.groupBy("site_key", "operation").agg(F.min(F.struct("page_ord", "mention_ord")).alias("seen"))
    lost = matched.filter(F.col("spec_operation").isNull()).join(seen, ["site_key", "operation"])
    lost = first_n(lost, ["site_key"], ["seen"], 5).groupBy("site_key").agg(
        ordered_texts(F.col("seen"), F.col("operation"), F.lit(True), 5).alias("lost")
    )
    rows = (
        sites.select("site_key").join(spec, "site_key", "left").join(totals, "site_key", "left").join(lost, "site_key", "left")
    )
    url, n, missing = F.col("spec_url"), F.coalesce("mentioned", F.lit(0)), F.col("missing")
    runs = url.isNotNull() & (n > 0)
    credit = F.when(runs, (n - missing) / n)
    status = F.when(~runs, "skip").otherwise(status_for_credit(credit, 1.0, 0.8))
    message = (
        F.when(url.isNull(), "No OpenAPI description was found, so the docs could not be compared with a spec.")
        .when(n == 0, F.concat(F.lit("Found "), url, F.lit(", but the sampled pages mention no endpoints to compare against it.")))
        .when(missing == 0, F.concat(F.lit("All "), n.cast("string"), F.lit(" endpoints mentioned on the sampled pages are in "), url, F.lit(".")))
        .otherwise(
            F.concat(missing.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" endpoints mentioned in the docs are not in "), url, F.lit("."))
        )
    )
    fix = F.when(runs & (missing > 0), "Update the docs or the OpenAPI file so both describe the same endpoints.")
    evidence = F.when(
        url.isNotNull(), F.concat(F.array(url), F.coalesce("lost", F.array().cast("array<string>")))
    )
    return native_check(rows, "api-spec-match", 29, status, credit, message, fix, evidence)


def deprecated_uses(mentions: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per (site, page, deprecated operation) with whether any mention of it carries a notice."""
    used = mentions.join(
        matched.filter("deprecated").select("site_key", "operation", "spec_operation"), ["site_key", "operation"]
    )
    return used.groupBy("site_key", "page", "spec_operation").agg(
        F.bool_or(F.col("context").rlike(K.DEPRECATION_NOTICE)).alias("notice"),
        F.min(F.struct("page_ord", "mention_ord")).alias("seen"),
    )


def deprecation_notices(
    sites: DataFrame, spec: DataFrame, operations: DataFrame, uses: DataFrame
) -> DataFrame:
    """``uses`` from ``deprecated_uses``."""
    marked = operations.groupBy("site_key").agg(F.count_if("deprecated").alias("marked"))
    totals = uses.groupBy("site_key").agg(F.count("*").alias("uses"), F.count_if(~F.col("notice")).alias("silent"))
    line = F.concat("spec_operation", F.lit(" on "), "page")
    quiet = first_n(uses.filter(~F.col("notice")), ["site_key"], ["seen", "spec_operation"], 5).groupBy("site_key").agg(
        ordered_texts(F.struct("seen", "spec_operation"), line, F.lit(True), 5).alias("quiet")
    )
    rows = (
        sites.select("site_key").join(spec, "site_key", "left").join(marked, "site_key", "left")
        .join(totals, "site_key", "left").join(quiet, "site_key", "left")
    )
    url, marks = F.col("spec_url"), F.coalesce("marked", F.lit(0))
    n, silent = F.coalesce("uses", F.lit(0)), F.col("silent")
    runs = url.isNotNull() & (marks > 0) & (n > 0)
    credit = F.when(runs, (n - silent) / n)
    status = F.when(~runs, "skip").otherwise(status_for_credit(credit))
    message = (
        F.when(url.isNull(), "No OpenAPI description was found, so deprecation notices could not be compared with a spec.")
        .when(marks == 0, F.concat(url, F.lit(" marks no operation as deprecated, so there is nothing to compare.")))
        .when(
            n == 0,
            F.concat(F.lit("The sampled pages do not use any of the "), marks.cast("string"), F.lit(" operations "), url, F.lit(" marks deprecated.")),
        )
        .when(
            silent == 0,
            F.concat(F.lit("All "), n.cast("string"), F.lit(" uses of deprecated operations on the sampled pages say the operation is deprecated.")),
        )
        .otherwise(
            F.concat(silent.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" uses of deprecated operations on the sampled pages do not say so."))
        )
    )
    fix = F.when(
        runs & (silent > 0), "Where the docs use a deprecated operation, say so next to it and point to its replacement."
    )
    evidence = F.when(url.isNotNull() & ~runs, F.array(url)).when(runs, F.col("quiet"))
    return native_check(rows, "deprecation-notices", 30, status, credit, message, fix, evidence)
