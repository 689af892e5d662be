"""Streaming: windowed event aggregates with late data, and running scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, value: tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: sessions that a gap ends."""
    held = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return held.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def into_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends finished windows and ends when all that has arrived is read."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def latest_windows(windows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Runs an aggregate stream until all that has arrived is read, and returns the last state of every key.

    Every batch writes what it changed as Parquet under its number, so that a batch that is run again replaces its own
    output; nothing is gathered on the driver. path: a folder that driver and executors share.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = windows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
    every = windows.sparkSession.read.schema(f"{columns}, batch int").parquet(f"{path}/out")
    last = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return every.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place", "batch")
