"""Shared scratch tables and Arrow batch sizes for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.workers import reachable

#: Rows in an Arrow batch that goes to Python; bounds a worker's memory for long texts.
ARROW_ROWS = 512
#: With it Spark removes the shuffle files of an execution at its end, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tables(spark: SparkSession) -> SparkSession:
    """Sets the batch size for Python stages and the workers' path; returns the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return reachable(spark)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local folder serves a local session (tests); on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage and survives lost executors.

    The shuffle files that the writing took are gone with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table by name."""
    return tables(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator needs and no others, so that extra columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
