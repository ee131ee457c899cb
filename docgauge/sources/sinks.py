"""The report store: nested reports under one folder, partitioned by methodology version and run.

A run number names one writing: writing it again replaces it, also with no rows, so a job or a stream's batch may be repeated. Scores of
different methodology versions never share a partition. A reader gets, for every site, its row from the latest run, so a run may hold only
the sites that it touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

_PLACE = "methodology_version string, run bigint"


class ReportStore:
    """``schema``: columns of a report without the partition columns; ``fmt``: parquet, orc or json."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> None:
        self.spark, self.path, self.fmt = spark, path, fmt
        given = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.schema = StructType([f for f in given.fields if f.name not in ("methodology_version", "run")])

    @classmethod
    def like(cls, reports: DataFrame, path: str, fmt: str = "parquet") -> ReportStore:
        return cls(reports.sparkSession, path, reports.schema, fmt)

    def _hadoop(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _partition(self, version: str, run: int) -> tuple[str, str]:
        return f"methodology_version={version}", f"run={run}"

    def write(self, reports: DataFrame, version: str, run: int) -> int:
        """Replaces the run's partition of this version by ``reports`` and returns their number."""
        seen = Observation()
        rows = reports.select(*self.schema.fieldNames()).observe(seen, F.count(F.lit(1)).alias("rows"))
        placed = rows.withColumns({"methodology_version": F.lit(version), "run": F.lit(run).cast("bigint")})
        writer = placed.write.format(self.fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("methodology_version", "run").save(self.path)
        written = seen.get["rows"]
        if not written:  # a dynamic overwrite without rows names no partition and would leave an earlier writing
            files, place = self._hadoop(*self._partition(version, run))
            files.delete(place, True)
        return written

    def _rows(self) -> DataFrame:
        schema = StructType(self.schema.fields + StructType.fromDDL(_PLACE).fields)
        files, place = self._hadoop()
        if not files.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(self.fmt).load(self.path)

    def history(self, version: str | None = None, until: int | None = None) -> DataFrame:
        """Every row written, with its version and run; the conditions prune partitions."""
        rows = self._rows()
        if version is not None:
            rows = rows.where(F.col("methodology_version") == version)
        return rows if until is None else rows.where(F.col("run") <= until)

    def read(self, version: str | None = None, until: int | None = None) -> DataFrame:
        """The latest row of each site and version, of runs up to ``until``. Only keys decide, so reports are not shuffled to find it."""
        keys = ["methodology_version", "site_key"]
        rows = self.history(version, until)
        latest = rows.groupBy(*keys).agg(F.max("run").alias("run"))
        return rows.join(latest, [*keys, "run"], "left_semi")

    def changes(self, version: str, before: int, after: int) -> DataFrame:
        """``site_key, score_before, score_after`` of sites whose score differs between the states after two runs."""
        old, new = (self.read(version, run).select("site_key", F.col("score").alias(f"score_{name}")) for run, name in ((before, "before"), (after, "after")))
        both = old.join(new, "site_key", "full")
        return both.where(~F.col("score_before").eqNullSafe(F.col("score_after")))

    def compact(self, version: str, until: int) -> int:
        """Puts the latest rows of runs up to ``until`` into run ``until`` and drops the earlier ones. Readers see the same rows at
        every moment: until the earlier runs go, run ``until`` only repeats what they hold."""
        staged = f"{self.path}/_compacting-{uuid.uuid4().hex}"
        self.read(version, until).drop("methodology_version", "run").write.format(self.fmt).save(staged)
        rows = self.write(self.spark.read.schema(self.schema).format(self.fmt).load(staged), version, until)
        files, place = self._hadoop(f"methodology_version={version}")
        for entry in files.listStatus(place):
            run = entry.getPath().getName().partition("=")[2]
            if run.isdigit() and int(run) < until:
                files.delete(entry.getPath(), True)
        files, place = self._hadoop(staged.rsplit("/", 1)[1])
        files.delete(place, True)
        return rows
