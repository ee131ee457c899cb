"""Captured tables and the report store: what is written is what is read, and writing again changes nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docgauge.operators.crawl import refusal_backoff
from docgauge.operators.sampling import pick_evenly
from docgauge.session import Scope
from docgauge.sources.capture import read_fetch_log, write_fetch_log
from docgauge.sources.sinks import ReportStore

REPORT = "site_key string, score int, checks array<struct<id:string,earned:double>>"


def reports(spark, rows):
    return spark.createDataFrame([(s, n, [("a", float(n))]) for s, n in rows], REPORT)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_store_reads_the_latest_run_of_each_site(spark, tmp_path, fmt):
    store = ReportStore(spark, str(tmp_path / "r"), REPORT, fmt)
    assert store.read().count() == 0
    assert store.write(reports(spark, [("a", 1), ("b", 2)]), "v1", 1) == 2
    assert store.write(reports(spark, [("a", 9)]), "v2", 1) == 1
    for _ in range(2):  # a run that is written again replaces itself
        store.write(reports(spark, [("b", 5), ("c", 6)]), "v1", 2)
    now = lambda *a: sorted((r.site_key, r.score, r.run) for r in store.read(*a).collect())
    assert now("v1") == [("a", 1, 1), ("b", 5, 2), ("c", 6, 2)] and now("v1", 1) == [("a", 1, 1), ("b", 2, 1)]
    assert now("v2") == [("a", 9, 1)] and len(now()) == 4
    assert sorted((r.site_key, r.score_before, r.score_after) for r in store.changes("v1", 1, 2).collect()) == [("b", 2, 5), ("c", None, 6)]
    assert store.write(reports(spark, []), "v1", 2) == 0  # a repeated run may have lost its rows
    assert now("v1") == [("a", 1, 1), ("b", 2, 1)]
    store.write(reports(spark, [("c", 3)]), "v1", 3)
    before = now("v1")
    assert store.compact("v1", 3) == 3
    assert [(s, n) for s, n, _ in now("v1")] == [(s, n) for s, n, _ in before] and {r for _, _, r in now("v1")} == {3}
    assert store.history("v1").count() == 3 and now("v2") == [("a", 9, 1)]


def test_only_wanted_versions_and_runs_are_read(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "r"), REPORT)
    for run in range(3):
        store.write(reports(spark, [("a", run)]), "v1", run)
    store.write(reports(spark, [("a", 7)]), "v2", 0)
    assert len(store.history("v1", 1).inputFiles()) > 0
    plan = store.history("v1", 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(methodology_version" in plan and "(run" in plan.split("PartitionFilters")[1]


LOG = "site_key string, fetch_ord bigint, url string, headers map<string,string>, status int, fetched_at timestamp"


def test_fetch_log_counts_what_does_not_fit_and_prunes_days(spark, tmp_path):
    folder = str(tmp_path / "log")
    at = lambda day: dt.datetime(2026, 1, day, 12)
    rows = [("s", i, f"https://x/{i}", {"a": "b"}, 200, at(1 + i % 3)) for i in range(9)]
    write_fetch_log(spark.createDataFrame(rows, LOG), folder)
    with open(f"{folder}/fetch_date=2026-01-02/part-bad.txt", "w") as out:
        out.write('{"site_key":"s","fetch_ord":\n{"site_key":"s","status":"many"}\nnot json\n')
    log = read_fetch_log(spark, folder, "json", since="2026-01-02", schema=LOG)
    assert [tuple(r) for r in log.accounting().orderBy("fetch_date").collect()] == [(dt.date(2026, 1, 2), 3, 3), (dt.date(2026, 1, 3), 3, 0)]
    assert sorted(r.line for r in log.bad.collect())[0] == "not json"
    assert log.bad.select("fetch_date").count() == 3 and log.rows.select("url").count() == 6  # whatever columns are asked for
    back = log.rows.orderBy("fetch_ord").first()
    assert (back.fetch_ord, back.headers, back.fetched_at) == (1, {"a": "b"}, at(2))
    assert not any("2026-01-01" in f for f in log.rows.inputFiles()) or "PartitionFilters: [isnotnull(fetch_date" in log.rows._jdf.queryExecution().toString()
    write_fetch_log(spark.createDataFrame([("s", 99, "u", {}, 404, at(3))], LOG), folder)  # a day again
    again = read_fetch_log(spark, folder, "json", schema=LOG)
    assert sorted(r.fetch_ord for r in again.rows.where("fetch_date = '2026-01-03'").collect()) == [99]
    assert again.rows.where("fetch_date = '2026-01-01'").count() == 3
    write_fetch_log(spark.createDataFrame(rows, LOG), str(tmp_path / "columns"), "parquet")
    columns = read_fetch_log(spark, str(tmp_path / "columns"), until="2026-01-01", schema=LOG)
    assert columns.rows.count() == 3 and columns.bad.count() == 0


def test_refusals_of_a_hot_origin_are_counted_in_buckets(spark):
    rng = random.Random(1)
    rows = [(("hot" if i % 3 else f"o{i % 7}"), dt.datetime(2026, 1, 1) + dt.timedelta(seconds=rng.randrange(500)), i, rng.choice([200, 429, 503, None])) for i in range(3000)]
    want, seen = {}, {}
    for origin, at, i, status in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[origin] = seen.get(origin, 0) + (status in (429, 503))
        want[i] = seen[origin]
    log = spark.createDataFrame(rows, "origin string, fetched_at timestamp, fetch_ord bigint, status int")
    for per_bucket in (100_000, 50):
        assert {r.fetch_ord: r.refusals for r in refusal_backoff(log, per_bucket).collect()} == want
    placed = refusal_backoff(log, 50)
    assert {r.spacing_ms for r in placed.where("refusals > 3").collect()} == {4000} and placed.columns == [*log.columns, "refusals", "spacing_ms"]


def test_even_picks_of_a_group_in_many_buckets(spark, monkeypatch):
    from docgauge.operators import common, sampling

    monkeypatch.setattr(sampling, "order_buckets", lambda df, keys, order: common.order_buckets(df, keys, order, per_bucket=40))
    values = [f"v{i:05}" for i in range(2000)]
    rows = [("hot", v) for v in values] + [("small", v) for v in values[:7]] + [("small", None)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(5)
    got = [(r.k, r.v) for r in pick_evenly(df, ["k"], "v", 13).collect()]
    assert sorted(v for k, v in got if k == "hot") == [values[int(i * (2000 / 13))] for i in range(13)]
    assert sorted((v or "") for k, v in got if k == "small") == ["", *values[:7]]
    placed = common.order_buckets(df, ["k"], F.col("v"), per_bucket=40).groupBy("k", "__bucket").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("k = 'hot'")
    spans = sorted((r["__bucket"], r.low, r.high) for r in placed.collect())
    assert len(spans) > 20 and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_a_scope_releases_its_own_tables_only(spark):
    mine, other = Scope(), Scope()
    a, b = mine.keep(spark.range(5)), other.keep(spark.range(6))
    assert a.count() == 5 and b.count() == 6
    mine.release()
    assert not a.storageLevel.useMemory and b.storageLevel.useMemory
    result = other.tied(b.where("id > 2"))
    assert result.count() == 3
    del result
    assert not b.storageLevel.useMemory
