"""Session helpers: settings the jobs assume, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; on a cluster pass none and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scope:
    """Tables that one run computes once and several of its operators read; releasing it drops these and no other run's.

    Page facts are the case in point: five checks read them, and without this each would parse every page again. Kept tables lie in
    memory and on disk of the executors; lost parts are recomputed. Stored tables are Parquet in the shared folder: what reads them
    starts from a scan, so plans of many steps stay small, and losing executors costs nothing.
    """

    def __init__(self) -> None:
        self._kept: list[DataFrame] = []
        self._stored: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def store(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/docgauge-{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._stored.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()
        while self._stored:
            spark, path = self._stored.pop()
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    def tied(self, df: DataFrame) -> DataFrame:
        """``df``, with whose last reference this scope ends: for callers that hand out one lazy result."""
        weakref.finalize(df, self.release)
        return df

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def kept(df: DataFrame, scope: Scope | None) -> DataFrame:
    """``df``, kept if there is a scope to keep it in."""
    return df if scope is None else scope.keep(df)


def stored(df: DataFrame, scope: Scope | None) -> DataFrame:
    """``df``, written and read back if there is a scope to store it in."""
    return df if scope is None else scope.store(df)
