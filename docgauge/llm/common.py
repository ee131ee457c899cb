"""What the operators of this subpackage share: reading tables, splits by document id, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"\x20\x09-\x0D"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the document id as text, modulo ``parts``; a null id belongs to part 0, which is never learned from here."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    Lost executors cost no recomputation and every reader sees the same rows. Files lie in a folder per application, which
    whoever keeps the shared folder may delete when the application has ended. Shuffle files of the job go when it is written, so the disk of a
    chain of such steps holds the shuffles of one; until then they stay, and lost ones are made again from the tables before.
    ``batch``: at most so many rows come to a Python function at once, for rows that carry whole texts, of which tasks and workers hold several batches.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    kept = {_DROP_SHUFFLES: spark.conf.get(_DROP_SHUFFLES, "false"), _BATCH_ROWS: spark.conf.get(_BATCH_ROWS)}
    spark.conf.set(_DROP_SHUFFLES, "true")
    if batch is not None and not 0 < int(kept[_BATCH_ROWS]) <= batch:
        spark.conf.set(_BATCH_ROWS, str(batch))
    try:
        df.write.parquet(path)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """``df``, the side of a join whose rows are made from few stored bytes (by a Python function, explode or from repeated values).

    Spark sizes such a side by the files it starts from, so it may take millions of rows for a table that fits the driver; this keeps it from
    sending them to all tasks: both sides are shuffled and sorted, of which crowded partitions can be split.
    """
    return df.hint("merge")


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table from ``written`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
