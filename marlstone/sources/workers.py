"""Makes the library importable in Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> SparkSession:
    """Adds the library's folder to the workers' path, for programs that found it by their own path only.

    Machines that have it elsewhere need it on PYTHONPATH or as a package, as any library.
    """
    held = spark.sparkContext.environment
    parts = [p for p in held.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in parts:
        held["PYTHONPATH"] = ":".join([*parts, ROOT])
    return spark
