"""Readers of captured tables: fetch log and transcripts, always with fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from docgauge import schemas as S
from docgauge.operators.common import first_per


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A captured table as parquet, ORC, JSON lines or CSV, without schema inference."""
    return spark.read.schema(schema).format(fmt).load(path)


_BAD = "__bad"
#: Captured texts that no table row may lose silently: these formats can hold rows that do not fit the schema.
_LOOSE = ("json", "csv")


def write_fetch_log(log: DataFrame, path: str, fmt: str = "json") -> None:
    """The fetch log in one folder a day of ``fetched_at`` (``fetch_date``); days that are written again are replaced."""
    dated = log.withColumn("fetch_date", F.to_date("fetched_at"))
    writer = dated.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("fetch_date").save(path)


@dataclass
class FetchLog:
    """``rows``: what fits the schema, with ``fetch_date``; ``bad``: ``fetch_date, line`` of what does not."""

    rows: DataFrame
    bad: DataFrame

    def accounting(self) -> DataFrame:
        """``fetch_date, n_rows, n_bad`` of every day that has either."""
        good = self.rows.groupBy("fetch_date").agg(F.count(F.lit(1)).alias("n_rows"))
        bad = self.bad.groupBy("fetch_date").agg(F.count(F.lit(1)).alias("n_bad"))
        joined = good.join(bad, "fetch_date", "full")
        return joined.select("fetch_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_bad")])


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet", since: str | None = None, until: str | None = None, schema: str = S.RESPONSES) -> FetchLog:
    """The captured responses of the days from ``since`` to ``until``; other days' folders are not read.

    A JSON or CSV line that does not fit is neither lost nor a row of nulls: it is in ``bad``. Parquet and ORC have none.
    """
    loose = fmt in _LOOSE
    reader = spark.read.schema("value string, fetch_date date" if loose else f"{schema}, fetch_date date")
    found = reader.format("text" if loose else fmt).load(path)
    if since is not None:
        found = found.where(F.col("fetch_date") >= F.lit(since).cast("date"))
    if until is not None:
        found = found.where(F.col("fetch_date") <= F.lit(until).cast("date"))
    if not loose:
        return FetchLog(found, spark.createDataFrame([], "fetch_date date, line string"))
    # Every line is parsed whole: a reader that skips unused columns would call a line good or bad by what a query asks of it.
    parse = F.from_json if fmt == "json" else F.from_csv
    fits = parse("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    parsed = found.withColumn("row", fits)
    bad = F.col("row").isNull() | F.col(f"row.{_BAD}").isNotNull()
    rows = parsed.where(~bad).select("row.*", "fetch_date").drop(_BAD)
    return FetchLog(rows, parsed.where(bad).select("fetch_date", F.col("value").alias("line")))


def read_transcripts(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Questions, source pages, agent fetches, answers and model usage under one folder."""
    tables = {
        "questions": S.QUESTIONS,
        "source_pages": S.SOURCE_PAGES,
        "agent_fetches": S.AGENT_FETCHES,
        "answers": S.ANSWERS,
        "model_usage": S.MODEL_USAGE,
    }
    return {name: read_table(spark, f"{root}/{name}", schema, fmt) for name, schema in tables.items()}


def settled_responses(responses: DataFrame) -> DataFrame:
    """One row per request: the last attempt, refusals (429, 503) kept only when nothing better followed."""
    refused = F.coalesce(F.col("status").isin(429, 503), F.lit(False))
    return first_per(
        responses.withColumn("__refused", refused.cast("int")),
        ["site_key", "method", "accept", "url"],
        [F.col("__refused"), F.col("fetch_ord").desc()],
    ).drop("__refused")
