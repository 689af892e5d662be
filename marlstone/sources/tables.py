"""Readers, explicit checks of what was read, and writers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import expr as E
from marlstone.sources.workers import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a directory."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sheet(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """A sheet exported as CSV, under an explicit schema; what does not parse is NULL."""
    return spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE")


def bounded(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)


def below_header(raw: DataFrame, marker: str, names: list[str], position: str = "pos") -> DataFrame:
    """Rows under the header row of an exported sheet, coerced.

    raw: string columns c0, c1, ... and a row position. The header is the first row whose c0, trimmed, is the
    marker; none is an error. The first name is a date, the others are doubles; a row without a date is dropped.
    """
    header = raw.where(F.trim("c0") == marker).agg(F.min(position).alias("p")).first().p
    if header is None:
        raise ValueError(f"no row starts with {marker!r}")
    body = raw.where(F.col(position) > header)
    first, *rest = names
    kept = body.select(F.col("c0").try_cast("date").alias(first), *(E.number(f"c{i}").alias(n) for i, n in enumerate(rest, 1)))
    return kept.where(F.col(first).isNotNull())


def trimmed_names(df: DataFrame) -> DataFrame:
    """The frame with spaces cut from its column names."""
    return df.toDF(*(c.strip() for c in df.columns))


def violations(df: DataFrame, required: Iterable[str] = (), positive: Iterable[str] = ()) -> dict[str, int]:
    """Missing columns (as -1) and counts of values that are not above 0, in one pass."""
    missing = {c: -1 for c in required if c not in df.columns}
    checks = [F.count_if(F.col(c) <= 0).alias(c) for c in positive if c in df.columns]
    found = df.agg(*checks).first().asDict() if checks else {}
    return missing | {c: n for c, n in found.items() if n}


def require(df: DataFrame, required: Iterable[str] = (), positive: Iterable[str] = ()) -> DataFrame:
    """The frame, or an error that lists all offending columns."""
    found = violations(df, required, positive)
    if found:
        raise ValueError(", ".join(f"{c}: {'missing' if n < 0 else f'{n} values not above 0'}" for c, n in sorted(found.items())))
    return df


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and an order-free hash of a frame's content and column names, which other engines can work out, too.

    A row's hash is the first 15 hexadecimal digits of the md5 of its names and its values as text, NULL as a mark.
    """
    names = F.lit(",".join(df.columns))
    text = F.concat_ws("|", names, *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns))
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(row).alias("xor_hash"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("sum_hash"))


def overwrite(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Writes Parquet and reads it again."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for intermediate data in the folder that spark.checkpoint.dir names.

    Where that is unset, a local folder serves a local session; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts its lineage, survives lost executors, is worked out once."""
    return overwrite(df, scratch(df.sparkSession, name))


def spread(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The frame as a table in the shared folder, dealt by columns over files for all tasks.

    For frames of few bytes a row and much work: small partitions of a shuffle are put together by their bytes, and
    such a table would be one file and one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return kept(df.repartition(n, *by), name)
