"""The monitor with files dropped in order and a late row, and the report refresh."""

import datetime as dt

from docgauge import schemas as S
from docgauge.streaming.monitor import stream_fetch_monitor, stream_report_upsert
from tests.test_scoring import checks, coverage

LOG = "site_key string, fetched_at timestamp, status int, failure string"


def at(minute):
    return dt.datetime(2026, 1, 1, 10, 0) + dt.timedelta(minutes=minute)


def test_monitor_counts_windows_and_drops_late_rows(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    batches = [
        [("a", at(1), 200, None), ("a", at(2), 429, None), ("b", at(3), None, "robots")],
        [("a", at(25), 200, None)],
        [("a", at(4), 200, None), ("a", at(45), 200, None)],
        [("a", at(70), 200, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(LOG).parquet(folder)
        query = (
            stream_fetch_monitor(stream).writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = {(r.site_key, r.window_start.minute): (r.requests, r.rate_limited, r.robots_blocked) for r in spark.read.parquet(out).collect()}
    # The row of minute 4 arrived after the watermark had passed its window.
    assert got[("a", 0)] == (2, 1, 0) and got[("b", 0)] == (1, 0, 1) and got[("a", 20)] == (1, 0, 0)


def test_upsert_rescores_touched_sites(spark, tmp_path):
    folder = str(tmp_path / "checks")
    checks(spark, [("a", 10, 5, "warn")]).write.parquet(folder)
    known = lambda: spark.read.schema(S.CHECK_RESULTS).parquet(folder)
    out = str(tmp_path / "reports")
    query = stream_report_upsert(
        spark.readStream.schema(S.CHECK_RESULTS).parquet(folder), known, lambda: coverage(spark),
        lambda df, n: df.select("site_key", "score").write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"),
    )
    query.awaitTermination()
    assert [(r.site_key, r.score) for r in spark.read.parquet(out).collect()] == [("s", 50)]
